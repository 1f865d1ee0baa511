"""Folders of the shipped test tables, under a name that no other module has."""

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
