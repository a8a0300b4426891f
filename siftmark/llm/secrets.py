"""Operator 1: secret scans whose false positives a random forest removes.

Candidates are private-key blocks, passwords in addresses, values of any length given to a name
that holds a credential word, and runs of ``min_run`` token characters or more.  A forest
trained from labelled findings decides on length, transitions between kinds of characters,
dictionary coverage, the path (here: the source) and the neighbouring words.  Trees are
grown on the driver from a bounded set of findings; every text is scanned whole.

The forest that is grown here without findings of the caller's own learns from
:func:`labelled_findings`: values of published credential formats, and their look-alikes.

Defined results: null and empty texts give no findings; rows that repeat give findings
each; a null path or doc_id is kept and scored as an unknown path; candidates of any length
are scored whole, and overlap never: blocks go before addresses, values and runs; without
labelled findings, or with one class only, all findings have the share of that class as their
score; an empty table gives no rows.  Positions count characters.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Labelled findings a forest is grown from at most, chosen by a hash.
MAX_FINDINGS = 20_000
#: Least characters of a run that nothing marks as a credential.
MIN_RUN = 16
# the body of a block ends at the next begin line, so that many open ones are scanned once
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----(?:(?!-----(?:BEGIN|END) )[\s\S])*-----END \1-----")
ADDRESS = re.compile(r"://[^\s/:@]{1,256}:([^\s/@]{1,256})@")
ASSIGNED = re.compile(
    r"(?i)(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)[\"']?+\s{0,4}+(?:=>|:=|[=:]|(?<=\s))\s{0,4}+(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"',;=:>][^\s\"',;]*))"
)
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]+")
#: Characters looked at on either side of a candidate.
CONTEXT = 48
# Words that name a credential, words that name harmless values, and common words.
CREDENTIAL_WORDS = frozenset("token secret password passwd pwd key apikey api auth bearer credential credentials access private signature session oauth client".split())
HARMLESS_WORDS = frozenset("sha sha1 sha256 md5 hash checksum digest commit revision rev uuid guid etag integrity example sample dummy placeholder test fixture image png data file path url http https".split())
PLACEHOLDERS = ("change", "your", "xxxx", "0000", "example", "replace", "****", "dummy", "sample", "here", "${", "%(", "<")
COMMON_WORDS = frozenset(
    """about after again application array because before between build change class client code comment config content
    create data default delete document error example field file first format from function group have header help
    http image import index input into item java key last license line link list load local main message method
    mode model module name node null number object option order other output package page param path plugin point
    print process project public query read release request require response result return right root sample schema
    script search secret server service session setting source start state static status string style support system
    table template test text that their there this time title token type under update user util value version view
    window with write your""".split()
)


@dataclass(frozen=True)
class Finding:
    """A candidate with its surroundings; ``label`` 1 is a secret."""

    path: str
    before: str
    value: str
    after: str
    label: int = 0


KINDS = np.full(128, 4, np.int8)
for _k, _signs in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=.~-")):
    KINDS[[ord(c) for c in _signs]] = _k
WORDS = re.compile(r"[A-Za-z]+")
TEXT_FEATURES = 9


def coverage(value: str) -> float:
    """Share of the candidate's characters that known words of four letters or more cover."""
    low, covered, at = value.lower(), 0, 0
    while at < len(low) - 3:
        for n in range(min(12, len(low) - at), 3, -1):
            if low[at : at + n] in COMMON_WORDS:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / max(1, len(low))


def features(f: Finding) -> list[float]:
    """Numbers the trees split on."""
    raw = np.frombuffer(f.value.encode("ascii", "replace"), np.uint8)
    kinds = KINDS[raw & 127]
    share = np.bincount(kinds, minlength=5) / len(kinds)
    steps = np.bincount(kinds[:-1] * 5 + kinds[1:], minlength=25).reshape(5, 5) / max(1, len(kinds) - 1)
    counts = np.bincount(raw, minlength=1)
    p = counts[counts > 0] / len(raw)
    low = f.value.lower()
    vowels = sum(low.count(c) for c in "aeiou") / len(low)
    runs = max((len(w) for w in WORDS.findall(f.value)), default=0) / len(low)
    hexadecimal = float(all(c in "0123456789abcdef-" for c in low))
    before, after = WORDS.findall(f.before.lower()), WORDS.findall(f.after.lower())
    near = before[-3:]
    path = f.path.lower()
    return [
        math.log(len(raw)), *share[:4], *steps.ravel()[[0, 1, 2, 5, 6, 7, 10, 11, 12]], float(-(p * np.log2(p)).sum()),
        vowels, runs, hexadecimal, coverage(f.value), low.count("-"), low.count("/"), low.count("."),
        float(any(w in CREDENTIAL_WORDS for w in near)), float(any(w in HARMLESS_WORDS for w in near)),
        float(any(w in HARMLESS_WORDS for w in after[:2])), float(f.before.rstrip()[-1:] in ("=", ":", '"', "'")), float(f.after[:1] in ('"', "'")),
        float(f.before[-1:].isalnum()), float("-----BEGIN" in f.value), float(f.before[-1:] == ":" and f.after[:1] == "@"), float(any(c in "(){}[]<>$% " for c in f.value)),
        float(any(x in low for x in PLACEHOLDERS)), float(any(x in path for x in ("test", "example", "mock", "doc", "fixture"))), float(path.rpartition(".")[2] in ("env", "cfg", "ini", "yml", "yaml", "json", "py", "js", "sh", "tf")),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right, share of label 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                below = x[inner, f[inner]] <= cut[at[inner]]
                at[inner] = np.where(below, left[at[inner]], right[at[inner]])
            total += share[at]
        return total / max(1, len(self.trees))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 0) -> Forest:
    """Bagged trees on Gini impurity, a root's share of the features tried at each node."""
    draw = np.random.default_rng(seed)
    tried = max(1, int(math.sqrt(x.shape[1])) + 1)
    grown = []
    for _ in range(trees):
        bag = draw.integers(0, len(y), len(y))
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            ones = int(y[rows].sum())
            nodes.append([-1, 0.0, 0, 0, ones / len(rows)])
            if level == depth or len(rows) < 2 * least or ones in (0, len(rows)):
                return me
            best = (1e-12, None, None)
            whole = 2 * ones * (len(rows) - ones) / len(rows)
            for f in draw.permutation(x.shape[1])[:tried]:
                order = np.argsort(x[rows, f], kind="stable")
                v, up = x[rows[order], f], np.cumsum(y[rows[order]])
                n = np.arange(1, len(rows))
                cut = np.flatnonzero((v[1:] > v[:-1]) & (n >= least) & (len(rows) - n >= least))
                if len(cut):
                    a, na = up[cut], cut + 1
                    b, nb = ones - a, len(rows) - na
                    gain = whole - 2 * a * (na - a) / na - 2 * b * (nb - b) / nb
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), int(f), (v[cut[k]] + v[cut[k] + 1]) / 2)
            if best[1] is not None:
                below = x[rows, best[1]] <= best[2]
                nodes[me][:4] = [best[1], best[2], grow(rows[below], level + 1), grow(rows[~below], level + 1)]
            return me

        grow(bag, 0)
        a = np.array(nodes)
        grown.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return Forest(grown)


def train(findings: Sequence[Finding], seed: int = 0) -> Forest:
    """A forest from labelled findings, MAX_FINDINGS of them at most: those whose values hash lowest."""
    findings = list(findings)
    if len(findings) > MAX_FINDINGS:
        findings = sorted(findings, key=lambda f: hashlib.sha256(f"{f.path}\0{f.value}".encode("utf-8", "surrogatepass")).digest())[:MAX_FINDINGS]
    if not findings:
        return Forest([])
    return grow_forest(np.array([features(f) for f in findings]), np.array([f.label for f in findings]), seed=seed)


# Signs of generated values, ends of files that hold settings, and of files that hold examples.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
PLAIN_PATHS = ("app/settings.py", "deploy/prod.env", "config/app.yml", "infra/main.tf", "lib/client.js", "run.sh", "notes", "mail/2019/03", "")
EXAMPLE_PATHS = ("tests/test_client.py", "docs/example.md", "spec/fixtures/user.json", "mock/server.js", "examples/login.py")


class Generator:
    """Values of published formats, by kind; ``secret`` kinds are credentials and ``harmless`` ones their look-alikes."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        some = lambda signs, *n: "".join(self.r.choices(signs, k=self.r.choice(n)))
        hexa, alnum, b64 = DIGITS + "abcdef", LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/"
        word = lambda: self.r.choice(sorted(COMMON_WORDS))
        sound = lambda: self.r.choice("bcdfghjklmnprstvwz") + self.r.choice("aeiou") + self.r.choice(["", "", "n", "r", "s", "t"])
        long_word = lambda: "".join(sound() for _ in range(self.r.randint(7, 12)))
        self.word, self.sound = word, sound
        lines = lambda signs: "\n".join(some(signs, 64) for _ in range(self.r.randint(2, 12)))
        self.secret = {
            "hexadecimal key": lambda: some(hexa, 32, 40, 48, 64), "alphanumeric key": lambda: some(alnum, 20, 24, 32, 40, 48), "base64 key": lambda: some(b64, 27, 43, 64) + "=" * self.r.randint(0, 2),
            "cloud access key": lambda: "AKIA" + some(UPPER + DIGITS, 16), "forge token": lambda: self.r.choice(["ghp_", "gho_", "glpat-"]) + some(alnum, 20, 36),
            "chat token": lambda: f"xox{self.r.choice('bp')}-{some(DIGITS, 11, 12)}-{some(alnum, 24)}", "web token": lambda: f"eyJ{some(alnum, 30, 60)}.eyJ{some(alnum, 40, 90)}.{some(alnum + '_-', 43)}",
            "payment key": lambda: self.r.choice(["sk_live_", "rk_live_"]) + some(alnum, 24), "maps key": lambda: "AIza" + some(alnum + "_-", 35), "package token": lambda: "npm_" + some(alnum, 36),
            "password": lambda: self.r.choice([some(alnum + "!#%*?", 8, 10, 12, 14), word().capitalize() + some(DIGITS, 2, 4) + self.r.choice("!#*?"), word() + some("!#%*", 1) + some(DIGITS, 1, 3)]),
            "address password": lambda: some(alnum + "!#$", 8, 12, 16),
            "key block": lambda: (k := self.r.choice(["RSA PRIVATE KEY", "EC PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])) and f"-----BEGIN {k}-----\n{lines(b64)}\n-----END {k}-----",
        }
        self.harmless = {
            "digest": lambda: some(hexa, 32, 40, 64), "commit": lambda: some(hexa, 40), "uuid": lambda: "-".join(some(hexa, m) for m in (8, 4, 4, 4, 12)),
            "identifier": lambda: "_".join(word() for _ in range(self.r.randint(2, 5))) + self.r.choice(["", "_2", "Test", "()"]), "camel case": lambda: "".join(word().capitalize() for _ in range(self.r.randint(2, 5))),
            "path": lambda: "/".join(word() for _ in range(self.r.randint(2, 6))) + self.r.choice([".py", ".html", "", "/"]), "host": lambda: f"{word()}{some(DIGITS, 0, 1)}.{word()}.{self.r.choice(['com', 'org', 'net'])}",
            "long word": lambda: (w := long_word()) and self.r.choice([w, w.upper(), w.capitalize(), w + "." + self.sound().capitalize()]), "words": lambda: "-".join(word() for _ in range(self.r.randint(3, 6))),
            "number": lambda: some(DIGITS, 10, 13, 16, 19), "date": lambda: f"20{some(DIGITS, 2)}-0{some('123456789', 1)}-1{some(DIGITS, 1)}T1{some(DIGITS, 1)}-0{some(DIGITS, 1)}", "rule": lambda: self.r.choice("-=._~") * self.r.randint(16, 60),
            "placeholder": lambda: self.r.choice(["changeme", "your-api-key", "YOUR_TOKEN_HERE", "xxxxxxxxxxxxxxxx", "00000000000000000000", "<password>", "${DB_PASSWORD}", "example", "********", "your-secret-goes-here", "%(token)s", "REPLACE_ME"]),
            "expression": lambda: f"{word()}{self.r.choice(['.', '_'])}{word()}{self.r.choice(['()', '[0]', '', '.value'])}", "plain value": lambda: self.r.choice(["true", "false", "null", "None", "str", "required", "string", "is", "and", "the", word(), word()]),
            "image data": lambda: "data/image/png/base64/iVBORw0KGgo" + some(b64, 60, 120), "example key": lambda: some(hexa, 32, 40), "sound": lambda: self.sound() + self.sound(),
        }

    def text(self, n: int) -> str:
        """Words between which a finding stands: known ones, and ones made of sounds."""
        return " ".join(self.word() if self.r.random() < 0.5 else "".join(self.sound() for _ in range(self.r.randint(1, 4))) for _ in range(n))

    def finding(self, kind: str, secret: bool) -> Finding:
        r = self.r
        value = (self.secret if secret else self.harmless)[kind]()
        path, before, after = r.choice(PLAIN_PATHS), self.text(4), self.text(4)
        sign, quote = r.choice([" = ", "=", ": ", " : "]), r.choice(['"', '"', "'", ""])
        name = r.choice(["token", "secret", "api_key", "apikey", "password", "access_key", "client_secret", "auth_token", "private_key"])
        if kind == "key block":
            before, after = before + "\n", "\n" + after
        elif kind == "address password":
            before, after = f"{before} {r.choice(['https', 'postgres', 'ftp', 'amqp'])}://{self.word()}:", f"@{self.word()}.{self.word()}.com/{self.word()}"
        elif kind == "password":
            before, after = f"{before} {r.choice(['password', 'passwd', 'pwd', 'db_password', 'passphrase'])}{sign}{quote}", f"{quote} {after}"
        elif secret:
            before, after = f"{before} {name.upper() if r.random() < 0.2 else name}{sign}{quote}", quote + r.choice([" ", "\n", ", "]) + after
        elif kind in ("digest", "commit"):
            before, after = f"{before} {r.choice(['sha256', 'md5', 'sha1', 'checksum', 'digest', 'etag', 'hash']) if kind == 'digest' else r.choice(['commit', 'revision', 'rev', 'parent'])}{r.choice([' ', ': ', '=', ' = '])}", " " + after
        elif kind == "uuid":
            before, after = f"{before} {r.choice(['id', 'uuid', 'guid', 'request'])}{sign}{quote}", f"{quote} {after}"
        elif kind in ("placeholder", "expression", "plain value"):
            before, after = f"{before} {name}{sign}{quote if kind == 'placeholder' else ''}", (quote if kind == "placeholder" else "") + r.choice([" ", "\n", ", "]) + after
        elif kind == "sound":  # prose that names a credential
            before, after = f"{before} {r.choice(['token', 'secret', 'password', 'bearer'])}{r.choice([' ', ' ', ': '])}", r.choice([" ", ". ", ", "]) + after
        elif kind == "example key":  # the same as a key, in a file of examples
            path, before, after = r.choice(EXAMPLE_PATHS), f"{before} {name}{sign}{quote}", f"{quote} {after}"
        else:
            before, after = before + " ", r.choice([" ", ", ", ".\n", ") "]) + after
        return Finding(path, before[-CONTEXT:], value, after[:CONTEXT], int(secret))


def labelled_findings(n: int = 4000, seed: int = 0, without: Sequence[str] = (), only: Sequence[str] = ()) -> list[Finding]:
    """Labelled findings for a first forest, half of them secrets; kinds ``without``, or ``only`` some."""
    g = Generator(seed)
    kinds = [[k for k in table if k not in without and (not only or k in only)] for table in (g.secret, g.harmless)]
    return [g.finding(kinds[side][k // 2 % len(kinds[side])], side == 0) for k in range(n) for side in [k % 2] if kinds[side]]


def candidates(text: str, min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Spans of the candidates of a text in order, without full stops and dashes at the ends of runs."""
    found: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        found += [m.span() for m in BLOCK.finditer(text)]
    if "://" in text:
        found += [m.span(1) for m in ADDRESS.finditer(text)]
    for m in ASSIGNED.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:
            while end > start and text[end - 1] in ".,;:!?)]}-":
                end -= 1
        if end > start:
            found.append((start, end))
    for m in RUN.finditer(text):
        start, end = m.span()
        if end - start >= min_run:
            while end > start and text[end - 1] in ".-_~":
                end -= 1
            if end - start >= min_run:
                found.append((start, end))
    kept: list[tuple[int, int]] = []
    # stable: of spans that start together the kinds' order counts; a later one that a kept one overlaps goes
    for start, end in sorted(found, key=lambda x: x[0]):
        if not kept or start >= kept[-1][1]:
            kept.append((start, end))
    return kept


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, path_col: str = "source", keep_rejected: bool = True, min_run: int = MIN_RUN) -> DataFrame:
    """A row for each candidate: ``doc_id, start, stop, sha256, score, is_secret``; the value itself stays unshown."""
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("sha256", pa.string()), ("score", pa.float64()), ("is_secret", pa.int32())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int | None, int, int, Finding]] = []
            for doc, path, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = cell.as_py() or ""
                for a, b in candidates(text, min_run):
                    found.append((doc, a, b, Finding(path or "", text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT])))
                if len(found) >= 5000:
                    yield rows(found)
                    found = []
            if found:
                yield rows(found)

    def rows(found) -> pa.RecordBatch:
        score = forest.score(np.array([features(f) for *_, f in found]))
        made = [(d, a, b, hashlib.sha256(f.value.encode("utf-8", "surrogatepass")).hexdigest(), round(float(s), 6), int(s >= threshold)) for (d, a, b, f), s in zip(found, score, strict=True) if keep_rejected or s >= threshold]
        columns = list(zip(*made, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=schema)

    return docs.select("doc_id", path_col, "text").mapInArrow(run, "doc_id long, start long, stop long, sha256 string, score double, is_secret int")


def secret_scan(docs: DataFrame, findings: Sequence[Finding] | None = None, threshold: float = 0.5) -> DataFrame:
    forest = train(labelled_findings() if findings is None else findings)
    return scan(docs, forest, threshold)
