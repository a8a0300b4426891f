"""Command line: compare two files, print a report, write JSON or HTML.

Exit codes: 0 done or help, 1 a file is missing or the run failed, 2 wrong usage.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from .options import CompareOptions, parse_modules

USAGE = """siftmark: how alike are two files, byte for byte?

    python -m siftmark.cli FIRST SECOND [settings]

Reports (the console always gets one):
  --json FILE            all sections and figures as JSON
  --html FILE            one page that needs nothing else

Settings, each with a whole number:
  --pattern-len N        length of the byte patterns that are counted; 16
  --min-occurrences N    repeats from which a one-sided pattern is listed; 2
  --block-size N         mean length that chunks are cut towards; 2048
  --shingle-k N          bytes of a sketched window; 8
  --entropy-block N      bytes that share one entropy value; 256

  --modules LIST         any of bytediff, fuzzy, format, entropy, patterns, by commas
  -h, --help             show this and stop
"""
# Integer options, the setting each changes, and its least value.
INTEGERS = {"--pattern-len": ("pattern_length", 1), "--min-occurrences": ("min_occurrences", 1), "--block-size": ("chunk_avg", 8), "--shingle-k": ("shingle_k", 1), "--entropy-block": ("entropy_block", 1)}


class UsageError(ValueError):
    pass


@dataclass
class Arguments:
    files: list[str] = field(default_factory=list)
    json: str | None = None
    html: str | None = None
    help: bool = False
    options: CompareOptions = field(default_factory=CompareOptions)


def parse(argv: Sequence[str]) -> Arguments:
    """Arguments of a command line; a wrong one raises UsageError."""
    out, settings, rest = Arguments(), {}, list(argv)
    while rest:
        arg = rest.pop(0)
        if arg in ("-h", "--help"):
            return Arguments(help=True)
        if not arg.startswith("-"):
            out.files.append(arg)
            continue
        if arg not in ("--json", "--html", "--modules", *INTEGERS):
            raise UsageError(f"{arg} is not a setting of this command")
        if not rest:
            raise UsageError(f"nothing follows {arg}")
        value = rest.pop(0)
        if arg in INTEGERS:
            name, least = INTEGERS[arg]
            try:
                settings[name] = int(value)
            except ValueError:
                settings[name] = least - 1
            if settings[name] < least:
                raise UsageError(f"{arg} takes a whole number from {least} on, not {value!r}")
        elif arg == "--modules":
            try:
                settings["modules"] = parse_modules(value)
            except ValueError as e:
                raise UsageError(str(e)) from None
        else:
            setattr(out, arg[2:], value)
    if len(out.files) != 2:
        raise UsageError(f"two files are compared; {len(out.files)} were named")
    out.options = CompareOptions().with_values(**settings)
    return out


def lenient_options(values: dict[str, str], modules: Sequence[str] = ()) -> CompareOptions:
    """Options from form fields: what is no fitting number keeps its default, no module means all."""
    settings = {}
    for option, (name, least) in INTEGERS.items():
        text = values.get(option.lstrip("-"), "").strip()
        if text.lstrip("+").isdigit() and int(text) >= least:
            settings[name] = int(text)
    return CompareOptions().with_values(**settings, modules=parse_modules(",".join(modules)))


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = parse(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        print(f"Error: {e}\n\n{USAGE}", file=sys.stderr)
        return 2
    if args.help:
        print(USAGE)
        return 0
    missing = [f for f in args.files if not os.path.isfile(f)]
    if missing:
        print(f"no such file: {missing[0]}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .plans.compare import results
    from .plans.report import html_report, modules_of, text_report, to_json
    from .sources.images import images_from_bytes, pairs_from

    spark = SparkSession.builder.appName("siftmark").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        names = [os.path.abspath(f) for f in args.files]
        payloads = {n: open(n, "rb").read() for n in names}  # noqa: SIM115  two local files by contract
        found = results(images_from_bytes(spark, payloads), pairs_from(spark, [("0", names[0], names[1])]), args.options).cache()
        row = found.first().asDict(recursive=True)
        print(text_report(row, modules_of(found)))
        if args.json:
            with open(args.json, "w", encoding="utf-8") as f:
                f.write(to_json(found).first()["json"])
        if args.html:
            with open(args.html, "w", encoding="utf-8") as f:
                f.write(html_report(row, modules_of(found)))
        return 0
    except Exception as e:  # noqa: BLE001  any failure is exit code 1
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
