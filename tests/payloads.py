"""Deterministic payloads."""

import struct


def pseudo(n: int, seed: int) -> bytes:
    """Low bytes of a splitmix64 stream."""
    out, state, full = bytearray(), seed, (1 << 64) - 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & full
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        out.append((z ^ (z >> 31)) & 255)
    return bytes(out)


def seeded(n: int, seed: int) -> bytes:
    """Low bytes of xorshift32."""
    out, s = bytearray(), seed | 1
    for _ in range(n):
        s ^= (s << 13) & 0xFFFFFFFF
        s ^= s >> 17
        s ^= (s << 5) & 0xFFFFFFFF
        out.append(s & 255)
    return bytes(out)


def minimal_pe(name: bytes, raw: bytes, machine=0x8664, subsystem=3, imports=()) -> bytes:
    """A PE file with one section; ``imports`` puts an import table before the raw data."""
    head = bytearray(0x80)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, 0x80)
    coff = b"PE\0\0" + struct.pack("<HHIIIHH", machine, 1, 1_600_000_000, 0, 0, 112, 0x22)
    optional = bytearray(112)
    struct.pack_into("<H", optional, 0, 0x10B)
    struct.pack_into("<I", optional, 16, 0x1000)
    struct.pack_into("<H", optional, 68, subsystem)
    start = 0x80 + len(coff) + 112 + 40
    body = b""
    if imports:
        at = 20 * (len(imports) + 1)
        names, table = b"", b""
        for n in imports:
            table += struct.pack("<IIIII", 0, 0, 0, 0x1000 + at + len(names), 0)
            names += n + b"\0"
        body = table + bytes(20) + names
        struct.pack_into("<I", optional, 96 + 8, 0x1000)
    body += raw
    section = name.ljust(8, b"\0") + struct.pack("<IIIIIIHHI", len(body), 0x1000, len(body), start, 0, 0, 0, 0, 0x60000020)
    return bytes(head) + coff + bytes(optional) + section + body


def minimal_elf(sections, wide=True, big=False, kind=2, machine=0x3E) -> bytes:
    """An ELF file with the given (name, type, bytes) sections after a null section."""
    o = ">" if big else "<"
    size = 0x40 if wide else 0x34
    rows = [(b"", 0, b""), *sections, (b".shstrtab", 3, b"")]
    names, places = b"", []
    for n, _, _ in rows:
        places.append(len(names))
        names += n + b"\0"
    rows[-1] = (b".shstrtab", 3, names)
    body, heads = b"", []
    for (n, t, raw), at in zip(rows, places, strict=True):
        offset, length = size + len(body), len(raw)
        if t != 8:
            body += raw
        if wide:
            heads.append(struct.pack(o + "IIQQQQIIQQ", at, t, 0, 0, offset, length, 0, 0, 0, 0))
        else:
            heads.append(struct.pack(o + "IIIIIIIIII", at, t, 0, 0, offset, length, 0, 0, 0, 0))
    ident = b"\x7fELF" + bytes([2 if wide else 1, 2 if big else 1]) + bytes(10)
    table = size + len(body)
    if wide:
        head = struct.pack(o + "HHIQQQIHHHHHH", kind, machine, 1, 0x401000, 0, table, 0, size, 0, 0, len(heads[0]), len(rows), len(rows) - 1)
    else:
        head = struct.pack(o + "HHIIIIIHHHHHH", kind, machine, 1, 0x401000, 0, table, 0, size, 0, 0, len(heads[0]), len(rows), len(rows) - 1)
    return ident + head + body + b"".join(heads)
