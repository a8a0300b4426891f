"""Small PE and ELF payloads: fixed heads to put before other bytes, for queries."""

from __future__ import annotations

import struct


def pe_sample(imports: tuple[str, ...] = (), section: str = ".idata") -> bytes:
    """An x64 console program of one section that holds an import table of ``imports``."""
    table, names = b"", b""
    for name in imports:
        table += struct.pack("<5I", 0, 0, 0, 0x2000 + 20 * (len(imports) + 1) + len(names), 0)
        names += name.encode() + b"\0"
    body = table + bytes(20) + names
    stub = b"MZ" + bytes(58) + struct.pack("<I", 64)
    optional = struct.pack("<H14xI", 0x20B, 0x1234) + bytes(48) + struct.pack("<H", 3)
    optional = optional.ljust(120, b"\0") + struct.pack("<II", 0x2000 if imports else 0, len(body))
    head = b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 1_600_000_000, 0, 0, len(optional), 0x22)
    start = len(stub) + len(head) + len(optional) + 40
    entry = section.encode().ljust(8, b"\0") + struct.pack("<IIII12xI", len(body), 0x2000, len(body), start, 0xC0000040)
    return stub + head + optional + entry + body


def elf_sample(sections: tuple[tuple[str, int, bytes], ...]) -> bytes:
    """A 64-bit little-endian program of the named sections (name, type, bytes), a null one first and their names last."""
    rows = [("", 0, b""), *sections, (".shstrtab", 3, b"")]
    names = b"".join(n.encode() + b"\0" for n, _, _ in rows)
    rows[-1] = (".shstrtab", 3, names)
    body, heads, at = b"", b"", 0
    for name, kind, raw in rows:
        heads += struct.pack("<IIQQQQIIQQ", at, kind, 0, 0, 64 + len(body), len(raw), 0, 0, 0, 0)
        at += len(name) + 1
        body += b"" if kind == 8 else raw
    head = b"\x7fELF\x02\x01".ljust(16, b"\0") + struct.pack("<HHIQQQIHHHHHH", 3, 0xB7, 1, 0x400, 0, 64 + len(body), 0, 64, 0, 0, 64, len(rows), len(rows) - 1)
    return head + body + heads
