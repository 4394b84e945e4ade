"""The symbol reader against files made by the format's own layout."""

import struct

from factloom.sources import binaries


def program(symbols):
    """An ELF file with a symbol table of (name, kind, section, size)."""
    names, table = b"\0", b"\0" * 24
    for name, kind, section, size in symbols:
        table += struct.pack("<IBBHQQ", len(names), kind, 0, section, 0, size)
        names += name.encode() + b"\0"
    head = b"\x7fELF\x02\x01" + b"\0" * 34 + struct.pack("<Q", 64 + len(table) + len(names)) + b"\0" * 10 + struct.pack("<HHH", 64, 3, 0)
    section = lambda kind, at, size, link, entry: struct.pack("<IIQQQQIIQQ", 0, kind, 0, 0, at, size, link, 0, 0, entry)
    return head + table + names + section(0, 0, 0, 0, 0) + section(2, 64, len(table), 2, 24) + section(3, 64 + len(table), len(names), 0, 0)


def test_functions_of_programs(spark, tmp_path):
    made = program([("seal", 18, 1, 40), ("open", 2, 3, 8), ("data", 17, 1, 4), ("outside", 18, 0, 0)])
    assert binaries.elf_functions(made) == [("open", 8), ("seal", 40)]
    assert binaries.elf_functions(made[:-1]) == [] and binaries.elf_functions(b"") == [] and binaries.elf_functions(b"\x7fELF") == []
    (tmp_path / "a").write_bytes(made)
    (tmp_path / "b").write_bytes(b"no program")
    assert sorted((r["symbol"], r["size"]) for r in binaries.linked_symbols(spark, str(tmp_path)).collect()) == [("open", 8), ("seal", 40)]
