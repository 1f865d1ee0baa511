def same(got, expected):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, expected), key=repr)
