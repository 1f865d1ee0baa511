"""HTML extraction with wrappers: union-free regular expressions inferred per host.

A page becomes a tree of labels (tag and classes) with text slots. The
children of a node are a union-free regular expression: a sequence of groups,
each label in a group optional or not, each group repeated or not, and no
choice between alternatives. Two such expressions are aligned; a label that
stands on one side only becomes optional, and where a label would stand twice
the stretch between folds into one repeated group of optional labels. So a
node's expression never names a label twice, and its size is bounded by the
template's labels, not by the pages. Merging wrappers two by two gives the
wrapper of all pages of a host, in any number of steps. Pages with the same
text (scripts, menus and the like aside) count as one: each page's wrapper is
dealt by host and text, each task merges the distinct ones it has (one row per
host and task), then the tasks' wrappers are merged.

A page's children are matched against the expressions, which give each its
slot. The wrapper tells which labels of a host form the main text: its article if
it has one, else its main part, else the node that holds most of the varying
text. Within it, menus, headers, footers, side bars, notices, adverts, forms,
scripts, styles and reader comments are left out by their labels (a class, id
or role as a whole, not a word in it; never html, body, main, an article or
what holds the article), and other
containers if their slot has the same text on every page that has it, and at
least five pages of different text have it; inside an article nothing is left
out for that. All other text is kept, block by block, in page order.

Defined cases: null or empty html: empty text; a null url belongs to the host
without a name; a page that does not match its host's expressions down to the
main text is read by the same label rules alone, and so is what lies below a
node of the main text whose children do not match; repeated rows are extracted
alike; of parts with equal mass the one with the larger label leads to the main
text; elements nested deeper than ``DEEPEST`` lie beside each other, with all
their text; a very long page is read whole by one task, in linear time, also if
its tags or quotes never end; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.runtime import prepare, rows_by_bytes, staged

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
                   "nav ol p pre section table ul".split())
SKIP_TAGS = frozenset("nav footer aside form script style noscript template iframe button select option textarea "
                      "input svg canvas object embed head title dialog menu".split())
SKIP_CLASSES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner promo sidebar aside menu nav "
                         "navigation navbar breadcrumb breadcrumbs header footer masthead notice notices cookie cookies consent "
                         "comment comments reply replies discussion disqus share sharing social related newsletter subscribe "
                         "popup modal widget toolbar topbar cookiebar adsbygoogle respond pagination pager foot".split())
BOX_WORDS = frozenset("site main top primary secondary mobile list item items box block bar slot unit buttons links form "
                      "user users reader readers visitor guest google area section wrapper container".split())
OTHERS = frozenset("comment comments reply replies discussion disqus related".split())
PAGE_TAGS = frozenset("#page html body main article".split())     # never left out for their names
CONSTANT_PAGES = 5             # a slot with one text on so many pages of different text, at least, is template
DEEPEST = 200                  # elements nested deeper lie beside each other in the last one that counts
MANY_LABELS = 64               # labels of one tag under a node before they are told apart by the tag alone

_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
_KEY = re.compile(r"[\s/]*([^\s=/><]*)\s*(=?)\s*")
_VALUE = re.compile(r"[^\s><]*")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_NAMES = frozenset(("class", "id", "role"))
_WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("label", "tag", "skip", "items")

    def __init__(self, label: str, tag: str, skip: bool):
        self.label, self.tag, self.skip = label, tag, skip
        self.items: list = []          # child nodes and strings


class _Reader:
    """Reads tags of a page, each character once: a tag ends at ``>``, or before a ``<`` that no quotes hold.

    A value is quoted only by a quote right behind its ``=``; a quote that is
    never closed is part of the value.
    """

    def __init__(self, page: str):
        self.page = page
        self.open_from = {'"': len(page), "'": len(page)}      # where the search for such a quote has found no other

    def comment(self, at: int) -> int:
        """The end of a comment, declaration or instruction."""
        mark = "-->" if self.page.startswith("<!--", at) else ">"
        end = self.page.find(mark, at + (4 if mark == "-->" else 2))
        return len(self.page) if end < 0 else end + len(mark)

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """(names and values of class, id and role; closed by ``/>``; end) of the tag whose name ends at ``at``."""
        page, n, found = self.page, len(self.page), []
        while at < n:
            if page[at] == ">":
                return found, page[at - 1] == "/", at + 1
            if page[at] == "<":
                return found, False, at
            m = _KEY.match(page, at)
            key, at = m.group(1), m.end()
            if not m.group(2):
                continue
            quote, end = page[at:at + 1], -1
            if quote and quote in self.open_from and at < self.open_from[quote]:
                end = page.find(quote, at + 1)
                if end < 0:
                    self.open_from[quote] = at
            if end >= 0:
                value, at = page[at + 1:end], end + 1
            else:
                v = _VALUE.match(page, at)
                value, at = v.group(), v.end()
            if key.lower() in _NAMES:
                found.append((key, value))
        return found, False, n


def parse(page: str) -> Node:
    """A lenient tree, in linear time; unclosed paragraphs and list items end where the next block begins."""
    root, read = Node("#page", "#page", False), _Reader(page)
    stack, at, n = [root], 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            stack[-1].items.append(page[at:])
            break
        if mark > at:
            stack[-1].items.append(page[at:mark])
        closing = page.startswith("</", mark)
        name = _NAME.match(page, mark + 1 + closing)
        if not name:
            if page[mark + 1:mark + 2] in ("!", "?") or closing:
                at = read.comment(mark)
            else:                                          # a character, not a tag
                stack[-1].items.append("<")
                at = mark + 1
            continue
        tag = name.group().lower()
        names, alone, at = read.attributes(name.end())
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P:
            _close(stack, "p")
        if tag == "li":
            _close(stack, "li", "ul", "ol")
        node = _node(tag, names)
        stack[-1].items.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            node.items.append(page[at:end.start() if end else n])
            at = read.attributes(end.end())[2] if end else n
        elif tag not in VOID and not alone and (len(stack) < DEEPEST or node.skip and not stack[-1].skip):
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str, *within: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in within or stack[k].tag not in INLINE and not within:
            return


def _node(tag: str, names: list[tuple[str, str]]) -> Node:
    """The label holds the words of class, id and role; ``!`` at its end marks names that are left out."""
    words: set[str] = set()
    skip = False
    for _, value in names:
        for token in value.lower().split():
            words.update(found := _WORDS.findall(token))
            skip = skip or _skip_name(token, found)
    skip = skip and tag not in PAGE_TAGS
    label = f"{tag}.{'.'.join(sorted(words))}" if words else tag
    return Node(f"{label}!" if skip else label, tag, skip or tag in SKIP_TAGS)


def _skip_name(token: str, words: list[str]) -> bool:
    """The whole name is one of those left out, or made of them and words for a box ("comment-list", not "has-comments")."""
    return token in SKIP_CLASSES or not SKIP_CLASSES.isdisjoint(words) and all(x in SKIP_CLASSES or x in BOX_WORDS for x in words)


# a wrapper node: {"n": pages, "mass": characters, "text": hash of the only text or None,
#                  "groups": [[{label: optional?}, repeated?], ...], "kids": {label: wrapper node}}

def infer(node: Node) -> dict:
    """The wrapper of one page; ``n`` is 1 in every node, also where a label stands several times."""
    kids: dict[str, dict] = {}
    order: list[str] = []
    own: list[str] = []
    text = xxhash.xxh64()           # of the node's strings and its children's texts, each part once
    for item in node.items:
        if isinstance(item, str):
            own.append(item)
            if words := item.split():
                text.update("\0".join(["", *words]).encode("utf-8", "surrogatepass"))
            continue
        if item.tag in RAW or item.tag in VOID:
            for part in item.items:
                text.update(part.encode("utf-8", "surrogatepass"))
            continue
        w = infer(item)
        text.update(w["text"].encode())
        if item.label in kids:
            _merge_into(kids[item.label], w, same_page=True)
        else:
            kids[item.label] = w
        order.append(item.label)
    return {"n": 1, "mass": len(" ".join("".join(own).split())), "text": text.hexdigest(),
            "groups": _fold([[label, False] for label in order]), "kids": kids}


def text_digest(root: Node) -> bytes:
    """Of the text that the label rules alone leave of a page: equal for copies, whatever their scripts, menus or adverts."""
    h = xxhash.xxh3_128()
    todo = list(reversed(root.items))
    blank = True
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            for word in x.split():
                h.update(word.encode("utf-8", "surrogatepass") + b" ")
                blank = False
        elif not (x.tag in RAW or x.tag in VOID or x.skip):
            todo += reversed(x.items)
    return b"" if blank else h.digest()


def _fold(steps: list[tuple[str, bool]]) -> list:
    """Groups in which no label stands twice: a stretch between two equal labels becomes a repeated group.

    A group is folded into once and then only added to, so a page's children take linear time.
    """
    out: list[list] = []                 # [labels: {label: optional}, repeated]
    where: dict[str, int] = {}           # a label's group
    loose: set[int] = set()              # groups whose labels are all optional
    for label, optional in steps:
        first = where.get(label)
        if first is None:
            where[label] = len(out)
            out.append([{label: optional}, False])
            continue
        group = out[first][0]
        out[first][1] = True
        if first == len(out) - 1 and len(group) == 1:
            continue
        if first not in loose:
            group.update(dict.fromkeys(group, True))
            loose.add(first)
        while len(out) > first + 1:
            taken = out.pop()[0]
            loose.discard(len(out))
            group.update(dict.fromkeys(taken, True))
            where.update(dict.fromkeys(taken, first))
    return out


def _align(a: list, b: list) -> list:
    """One sequence of groups that both match; what one side lacks is optional."""
    where = {label: j for j, g in enumerate(b) for label in g[0]}
    out: list[list] = []
    done = 0
    for labels, repeated in a:
        hits = sorted({where[x] for x in labels if x in where})
        if not hits:
            out.append([dict.fromkeys(labels, True), repeated])
            continue
        for g in b[done:hits[0]]:
            out.append([dict.fromkeys(g[0], True), g[1]])
        merged, again = dict(labels), repeated
        taken = b[max(done, hits[0]):hits[-1] + 1]
        for other, more in taken:
            for x in other:
                merged[x] = merged.get(x, True) or other[x]
            again = again or more
        seen = {x for g in taken for x in g[0]}
        merged = {x: o or x not in labels or x not in seen for x, o in merged.items()}
        out.append([merged, again or len(taken) > 1])
        done = max(done, hits[-1] + 1)
    out += [[dict.fromkeys(g[0], True), g[1]] for g in b[done:]]
    return _crossed(out)


def _crossed(groups: list) -> list:
    """Crossings leave a label in two groups: fold the stretch between."""
    result: list[list] = []
    for labels, repeated in groups:
        first = next((i for i, g in enumerate(result) if g[0].keys() & labels.keys()), None)
        if first is None:
            result.append([labels, repeated])
        else:
            merged = {}
            for g in [*result[first:], [labels, True]]:
                merged.update(dict.fromkeys(g[0], True))
            result[first:] = [[merged, True]]
    return result


def _merge_into(a: dict, b: dict, same_page: bool = False) -> None:
    a["n"] = max(a["n"], b["n"]) if same_page else a["n"] + b["n"]
    a["mass"] += b["mass"]
    if a["text"] != b["text"]:
        a["text"] = None
    a["groups"] = _align(a["groups"], b["groups"])
    for label, kid in b["kids"].items():
        if label in a["kids"]:
            _merge_into(a["kids"][label], kid, same_page)
        else:
            a["kids"][label] = kid
    _generalise(a)


def _generalise(a: dict) -> None:
    """Labels that differ in names only, and are too many, count as their tag."""
    if len(a["kids"]) <= MANY_LABELS:
        return
    tags: dict[str, list[str]] = {}
    for label in a["kids"]:
        tags.setdefault(label.partition(".")[0], []).append(label)
    for tag, labels in tags.items():
        plain = [x for x in labels if not _skip_label(x)]
        if len(plain) > MANY_LABELS // 2:
            kept = a["kids"].pop(plain[0])
            for x in plain[1:]:
                _merge_into(kept, a["kids"].pop(x))
            a["kids"][tag] = kept
            swap = set(plain)
            a["groups"] = _crossed([[{tag if x in swap else x: o or x in swap for x, o in g[0].items()}, g[1]] for g in a["groups"]])


def main_path(wrapper: dict) -> list[str]:
    """Labels from the page down to the node that holds the main text; [] for the whole page."""
    for wanted in (lambda tag, names: tag == "article", lambda tag, names: tag == "main" or "main" in names):
        if (path := _find(wrapper, wanted)) is not None:
            return path
    for wanted in (lambda tag, names: tag == "article", lambda tag, names: tag == "main"):
        if (path := _find(wrapper, wanted, True)) is not None:     # names do not leave out a node that holds the article
            return path
    path, node = [], wrapper
    while True:                      # down while one part holds most of what varies
        parts = {label: _mass(kid) for label, kid in node["kids"].items() if not _skip_label(label) and _tag(label) not in INLINE}
        best = max(parts, key=lambda x: (parts[x], x), default=None)
        if best is None or _tag(best) in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "table") \
                or not parts[best] or parts[best] < 0.8 * _mass(node):
            return path
        path.append(best)
        node = node["kids"][best]


def _tag(label: str) -> str:
    return label.partition(".")[0]


def _skip_label(label: str) -> bool:
    return label[-1] == "!" or _tag(label) in SKIP_TAGS or _tag(label) == "header"


def _mass(node: dict) -> int:
    """Characters of varying text, without what is never main text."""
    own = node["mass"] if node["text"] is None or node["n"] < CONSTANT_PAGES else 0
    return own + sum(_mass(k) for label, k in node["kids"].items() if not _skip_label(label))


def _find(node: dict, wanted, within_skipped: bool = False) -> list[str] | None:
    """The first such label from the top. Within nodes left out for their names only if it holds more text than
    all that is not left out, and not among comments and links to other articles."""
    level = [([], node)]
    least = _mass(node) if within_skipped else -1
    while level:
        below = []
        for path, x in level:
            for label, kid in x["kids"].items():
                if _skip_label(label) and not (within_skipped and _may_hold_article(label)):
                    continue
                if wanted(_tag(label), frozenset(label.split(".")[1:])) and _mass(kid) > least:
                    return [*path, label]
                below.append(([*path, label], kid))
        level = below
    return None


def _may_hold_article(label: str) -> bool:
    return (_tag(label) not in SKIP_TAGS or _tag(label) == "form") and OTHERS.isdisjoint(label.rstrip("!").split(".")[1:])


def extract(root: Node, wrapper: dict | None) -> str:
    path = main_path(wrapper) if wrapper else []
    tops = _at(root, path, wrapper) if path else []
    whole = any(_tag(label) == "article" for label in path)      # nothing of an article is dropped as template
    if not tops:                       # not as the host's other pages: by its labels alone
        own = infer(root)
        path = main_path(own)
        tops = _at(root, path, own) if path else [(root, own)]
        wrapper = None
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    def visit(node: Node, w: dict | None) -> None:
        slots = _slots(node, w) or {}
        for item in node.items:
            if isinstance(item, str):
                run.append(item)
            elif item.tag == "br":
                run.append("\n")
            elif item.tag in VOID or item.tag in RAW or item.skip:
                if item.tag not in INLINE:
                    end()
            elif item.tag == "header" and not _has_title(item):
                end()
            else:
                below = slots.get(id(item))
                block = item.tag not in INLINE
                if block:
                    end()
                if not (block and _constant(item, below)):
                    visit(item, below)
                if block:
                    end()

    for top, w in tops:
        end()
        visit(top, w if wrapper and not whole else None)
    end()
    return "\n\n".join(blocks)


def _constant(node: Node, w: dict | None) -> bool:
    """A container (not a paragraph or heading) with one text on all pages that have it."""
    return (w is not None and node.tag in ("div", "section", "ul", "table", "figure") and w["n"] >= CONSTANT_PAGES
            and w["text"] is not None)


def _has_title(node: Node) -> bool:
    return any(not isinstance(x, str) and (x.tag == "h1" or _has_title(x)) for x in node.items)


def _slots(node: Node, w: dict | None) -> dict[int, dict] | None:
    """The slot of each child by its ``id``, if the children match the wrapper node's expression; else None."""
    if w is None:
        return None
    where = {label: i for i, g in enumerate(w["groups"]) for label in g[0]}
    slots: dict[int, dict] = {}
    seen: set[str] = set()
    at = -1
    for item in node.items:
        if isinstance(item, str) or item.tag in RAW or item.tag in VOID:
            continue
        label = item.label if item.label in where else item.tag
        i = where.get(label, -1)
        if i < at or i < 0 or i == at and not w["groups"][i][1]:
            return None
        at = i
        seen.add(label)
        slots[id(item)] = w["kids"][label]
    if any(not optional and label not in seen for g in w["groups"] for label, optional in g[0].items()):
        return None
    return slots


def _at(node: Node, path: list[str], w: dict) -> list[tuple[Node, dict]]:
    """The nodes at the end of the path and their slots; a node on the way whose children do not match leads nowhere."""
    level = [(node, w)]
    for label in path:
        level = [(k, slots[id(k)]) for n, x in level if (slots := _slots(n, x)) for k in n.items
                 if not isinstance(k, str) and id(k) in slots and slots[id(k)] is x["kids"].get(label)]
    return level


def host_of(url) -> F.Column:
    found = F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each page; what a task has handed over already is left out."""
    seen: set[bytes] = set()
    for batch in rows_by_bytes(batches, "html"):
        out: dict[str, list] = {"host": [], "digest": [], "wrapper": []}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            root = parse(page)
            text, wrapper = text_digest(root), json.dumps(infer(root))
            key = xxhash.xxh3_128_digest(b"\0".join((host.encode(), text, wrapper.encode())))
            if key not in seen:
                seen.add(key)
                out["host"].append(host)
                out["digest"].append(text)
                out["wrapper"].append(wrapper)
        yield pa.RecordBatch.from_pydict({"host": pa.array(out["host"], pa.string()), "digest": pa.array(out["digest"], pa.binary()),
                                          "wrapper": pa.array(out["wrapper"], pa.string())})


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, digest and wrapper: one wrapper per distinct page text counts, the first."""
    wrappers: dict[str, dict] = {}
    last = None
    for batch in batches:
        for host, digest, text in zip(*(batch.column(c).to_pylist() for c in ("host", "digest", "wrapper"))):
            if (host, digest) == last:
                continue
            last = host, digest
            w = json.loads(text)
            if host in wrappers:
                _merge_into(wrappers[host], w)
            else:
                if len(wrappers) > 2000:         # a task of many hosts hands over what it has
                    yield _rows(wrappers)
                    wrappers = {}
                wrappers[host] = w
    yield _rows(wrappers)


def _rows(wrappers: dict[str, dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"host": pa.array(list(wrappers), pa.string()),
                                       "wrapper": pa.array([json.dumps(w) for w in wrappers.values()], pa.string())})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host: one host's wrapper in memory at a time."""
    host, held, out = None, None, {}
    for batch in batches:
        for name, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
            w = json.loads(text)
            if name == host:
                _merge_into(held, w)
            else:
                if held is not None:
                    out[host] = held
                host, held = name, w
        if len(out) > 500:
            yield _rows(out)
            out = {}
    if held is not None:
        out[host] = held
    yield _rows(out)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON), a row per host."""
    prepare(pages.sparkSession)
    source = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    # pages are dealt by host and text, so a host with most of them is many tasks' work
    each = source.filter("html IS NOT NULL").mapInArrow(_page, "host string, digest binary, wrapper string")
    first = (each.repartition("host", "digest").sortWithinPartitions("host", "digest", "wrapper")
             .mapInArrow(_infer, "host string, wrapper string"))
    return staged(first.repartition("host").sortWithinPartitions("host").mapInArrow(_merge, "host string, wrapper string"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in rows_by_bytes(batches, "html"):
        texts = []
        for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
            if wrapper is not None and host not in known:
                if len(known) > 500:
                    known.clear()
                known[host] = json.loads(wrapper)
            texts.append(extract(parse(page), known.get(host)) if page else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, a row per input row."""
    wrappers = infer_wrappers(pages, url_col, html_col)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    return (source.join(wrappers, "host", "left").mapInArrow(_extract, "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
