"""PE and ELF headers, section tables and import names of one payload."""

from __future__ import annotations

import struct
from datetime import datetime, timezone

from .kernels import block_entropy, histogram, sha256_upper

# Names of header codes.
PE_MACHINES = {0x8664: "x64", 0x14C: "x86", 0xAA64: "ARM64", 0x1C0: "ARM", 0x200: "IA64", 0: "Unknown"}
PE_SUBSYSTEMS = {1: "Native", 2: "GUI", 3: "Console", 9: "WinCE-GUI", 10: "EFI-Application", 0: "Unknown"}
ELF_MACHINES = {0x3E: "x86-64", 0x03: "x86", 0xB7: "AArch64", 0x28: "ARM", 0x08: "MIPS", 0x14: "PowerPC", 0: "Unknown"}
ELF_TYPES = {1: "REL", 2: "EXEC", 3: "DYN", 4: "CORE", 0: "NONE"}
ELF_SECTION_TYPES = {0: "NULL", 1: "PROGBITS", 2: "SYMTAB", 3: "STRTAB", 4: "RELA", 8: "NOBITS", 9: "REL", 11: "DYNSYM"}
#: Most sections of a PE table, most import descriptors, longest import name.
MAX_SECTIONS, MAX_DESCRIPTORS, MAX_NAME = 4096, 4096, 256
NOBITS = 8

SECTION_TYPE = "name string, virtual_size long, raw_size long, entropy double, sha256 string, flags string, bins array<long>"
SUMMARY_TYPE = (
    "format string, machine string, time_stamp string, subsystem string, entry_point string, "
    f"sections array<struct<{SECTION_TYPE.replace(' string', ':string').replace(' long', ':long').replace(' double', ':double').replace(' array', ':array')}>>, imports array<string>"
)


def unknown() -> dict:
    return {"format": "Unknown", "machine": "", "time_stamp": "", "subsystem": "", "entry_point": "", "sections": [], "imports": []}


def code_name(names: dict[int, str], code: int, decimal: bool = False) -> str:
    return names.get(code, str(code) if decimal else f"0x{code:X}")


class Reader:
    """Bounds-checked integers of a payload; a read that does not fit is 0."""

    def __init__(self, data: bytes, big: bool = False):
        self.data, self.order = data, ">" if big else "<"

    def fits(self, at: int, size: int) -> bool:
        return 0 <= at and at + size <= len(self.data)

    def _read(self, kind: str, size: int, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0] if self.fits(at, size) else 0

    def u16(self, at: int) -> int:
        return self._read("H", 2, at)

    def u32(self, at: int) -> int:
        return self._read("I", 4, at)

    def u64(self, at: int) -> int:
        return self._read("Q", 8, at)

    def text(self, at: int, limit: int) -> str:
        """Characters from ``at`` to a NUL or ``limit``; what is not printable ASCII becomes a full stop."""
        if not 0 <= at < len(self.data):
            return ""
        raw = self.data[at : max(at, limit)].partition(b"\0")[0]
        return "".join(chr(c) if 0x20 <= c < 0x7F else "." for c in raw)

    def slice(self, at: int, size: int) -> bytes:
        return self.data[at : at + size] if 0 <= at < len(self.data) and size > 0 else b""


def _section(name: str, virtual: int, raw: int, body: bytes, flags: str) -> dict:
    return {
        "name": name, "virtual_size": virtual, "raw_size": raw, "flags": flags,
        "entropy": float(block_entropy(body, len(body))[0]) if body else 0.0,
        "sha256": sha256_upper(body) if body else "", "bins": histogram(body).tolist() if body else None,
    }


def time_text(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if seconds else ""


def pe_flags(bits: int) -> str:
    return "".join(letter if bits & bit else "-" for letter, bit in (("R", 0x40000000), ("W", 0x80000000), ("X", 0x20000000)))


def parse_pe(data: bytes) -> dict | None:
    r = Reader(data)
    pe = r.u32(0x3C)
    if not r.fits(0x3C, 4) or pe + 24 > len(data) or data[pe : pe + 4] != b"PE\0\0":
        return None
    optional, size = pe + 24, r.u16(pe + 20)
    entry = subsystem = imports_at = 0
    if size and optional + 2 <= len(data):
        entry, subsystem = r.u32(optional + 16), r.u16(optional + 68)
        imports_at = r.u32(optional + (112 if r.u16(optional) == 0x20B else 96) + 8)
    table = optional + size
    number = min(r.u16(pe + 6), max(0, len(data) - table) // 40, MAX_SECTIONS)
    sections, places = [], []
    for at in range(table, table + 40 * number, 40):
        virtual, address, raw, start = (r.u32(at + k) for k in (8, 12, 16, 20))
        sections.append(_section(r.text(at, min(at + 8, len(data))), virtual, raw, r.slice(start, raw), pe_flags(r.u32(at + 36))))
        places.append((address, max(virtual or raw, raw), start))
    return {
        "format": "PE", "machine": code_name(PE_MACHINES, r.u16(pe + 4)), "time_stamp": time_text(r.u32(pe + 8)),
        "subsystem": code_name(PE_SUBSYSTEMS, subsystem, decimal=True), "entry_point": f"0x{entry:X}",
        "sections": sections, "imports": _pe_imports(r, imports_at, places) if imports_at else [],
    }


def file_offset(rva: int, places: list[tuple[int, int, int]]) -> int:
    """Offset of a virtual address by the first section that holds it, or -1."""
    return next((rva - address + start for address, size, start in places if address <= rva < address + size), -1)


def _pe_imports(r: Reader, rva: int, places: list[tuple[int, int, int]]) -> list[str]:
    start, names = file_offset(rva, places), {}
    for k in range(MAX_DESCRIPTORS if start >= 0 else 0):
        entry = r.data[start + 20 * k : start + 20 * k + 20]
        if len(entry) < 20 or not any(entry):
            break
        at = file_offset(struct.unpack_from("<I", entry, 12)[0], places) if any(entry[12:16]) else -1
        name = r.text(at, at + MAX_NAME).upper() if at >= 0 else ""
        if name:
            names.setdefault(name)
    return list(names)


def parse_elf(data: bytes) -> dict | None:
    if len(data) < 24 or data[4] not in (1, 2):
        return None
    wide, r = data[4] == 2, Reader(data, big=data[5] == 2)
    if len(data) < (0x40 if wide else 0x34):
        return None
    word = r.u64 if wide else r.u32
    table, counts = word(0x28 if wide else 0x20), 0x3A if wide else 0x2E
    size, number, names = (r.u16(counts + k) for k in (0, 2, 4))
    found = {
        "format": "ELF", "machine": code_name(ELF_MACHINES, r.u16(18)), "time_stamp": "", "subsystem": code_name(ELF_TYPES, r.u16(16)),
        "entry_point": f"0x{word(0x18):X}", "sections": [], "imports": [],
    }
    # an offset with the top bit set counts as negative: no table
    if not size or not 0 < table < min(len(data), 1 << 63):
        return found
    heads = []
    for at in range(table, table + size * min(number, (len(data) - table) // size), size):
        offset, length = (word(at + k) for k in ((0x18, 0x20) if wide else (0x10, 0x14)))
        offset, length = (x - (1 << 64) if x >> 63 else x for x in (offset, length))
        heads.append((r.u32(at), r.u32(at + 4), offset, length))
    text_at, text_size = heads[names][2:] if names < len(heads) else (-1, 0)
    for name_at, kind, offset, length in heads:
        name = r.text(text_at + name_at, min(text_at + text_size, len(data))) if text_at >= 0 and name_at < text_size else ""
        body = r.slice(offset, length) if kind != NOBITS else b""
        found["sections"].append(_section(name, length, 0 if kind == NOBITS else length, body, code_name(ELF_SECTION_TYPES, kind)))
    return found


def parse_executable(data: bytes) -> dict:
    """The format summary of a payload; whatever can't be read as PE or ELF is Unknown."""
    found = None
    if data[:2] == b"MZ":
        found = parse_pe(data)
    elif data[:4] == b"\x7fELF":
        found = parse_elf(data)
    return found or unknown()
