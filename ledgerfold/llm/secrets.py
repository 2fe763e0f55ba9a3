"""Secret scans: base patterns, and zstandard novelty for strings they don't know.

A candidate is a long string of token characters in sensitive context: it
follows a sensitive word on its line; or its line is only a value and comes
after a line that ends with a sensitive word, blank and value lines between
them apart; or it is in the body of a PEM private key. A value with a label of
its own is judged by that.

A candidate's novelty is what it adds to the compressed size of the code around
it, with a dictionary of common identifiers primed. The dictionary is trained
on the names of Python's standard library, so it brings the letter statistics
of identifiers too: names, paths and repeated values cost little, random keys
six bits a character or more, even when they are letters only. Constants and
CamelCase count in small letters, as they are names; digits alone carry too few
bits and are no candidates; a short surrounding is filled up with plain code,
as tiny frames cost more. The places of the same string in sensitive context
are taken out of the code around, so that two uses of a secret don't hide each
other; a string that also stands there in the open stays known by that. The
values of one key or label are judged as one value too, since random lines make
each other's letters cheap. Candidates that cost MIN_NOVELTY bytes a character
or more, alone or as one, are reported as kind "novel", unless a base span
holds them.

One narrow pass; nothing is shuffled. Spans are code points, end exclusive.

Defined results: null text is empty; texts without a span get zero counts and
the digest of the empty string; repeated rows are judged alike; extra columns
stay, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import keyword
import random
import re
import sys
import sysconfig
from bisect import bisect_left, bisect_right
from functools import lru_cache
from pathlib import Path

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words near which a string is worth testing, in lower case.
SENSITIVE = ("key", "auth", "cred", "passw", "secret", "token", "bearer", "private", "session", "signature", "pwd")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Words that begin with a capital: two small letters follow each.
CAMEL = re.compile(r"(?:[A-Z]?[a-z]{2,}[^A-Za-z]*+)++")
#: A line that is only a value, quoted, listed or continued; a PEM private key up to what can't be in its body. Both in linear time.
VALUE_LINE = re.compile(r"""[\s>#*/"'(+-]*+[a-z0-9+/_=-]++(?:\\n)?+["']?+[\s,;)\\+]*+""", re.A | re.I)
PEM = re.compile(r"""-{4,5} ?begin [a-z0-9 ]*private key[a-z0-9 ]*-{4,5}(?:(?:proc-type|dek-info|comment|version|hash|charset):[^\n]*|[a-z0-9+/=_\s"',>#*-]|\\[nr])*+""", re.A)
PEM_END = re.compile("-{4,5} ?end ")
BEFORE, AROUND, MIN_NOVELTY, LEVEL, DICTIONARY_BYTES = 48, 256, 0.71, 3, 24_000
IDENTIFIERS = b"""
 import export require return function const let var class public private protected static final void string integer boolean
 true false null none self this new delete def async await yield lambda try except catch finally raise throw if else elif for while
 api_key apikey access_key secret_key private_key public_key client_id client_secret auth_token access_token refresh_token id_token
 session_token bearer authorization authentication credentials password passwd username user_name email hostname database connection
 content_type application_json user_agent content_length accept_encoding cache_control x_request_id x_api_key
 getElementById addEventListener toString hasOwnProperty prototype constructor configuration environment variables settings
 https://www.example.com/path/to/resource?query=value&page=1 http://localhost:8080/index.html /usr/local/bin /home/user/.config
 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000 aaaaaaaaaaaaaaaa
 placeholder your_api_key_here changeme xxxxxxxxxxxxxxxx EXAMPLE_KEY sha256 base64 uuid timestamp created_at updated_at
"""


#: The modules whose names are learned as identifiers.
MODULES = (
    "os posixpath socket http.client http.server urllib.request urllib.parse ssl email.message logging threading subprocess json.decoder json.encoder datetime "
    "collections asyncio.base_events argparse configparser hashlib hmac ftplib smtplib unittest.case xml.dom.minidom zipfile shutil inspect _pydecimal"
).split()
#: Plain code around a candidate that has little around it.
FILL = """
for row in table.rows():
    total += row.amount * rate
    if row.kind == "late" and row.days > 30:
        report.add(row, note="second letter was sent")
print(f"{total:.2f} over {len(table)} rows, see the chart on page two")
# the plan for next week is to move the old jobs to the new queue
"""


NAME = re.compile(r"(?:\bdef |\bclass |\.)([A-Za-z_]{3,})|^([A-Za-z_]{3,}) *=", re.M)


@lru_cache(maxsize=1)
def dictionary() -> bytes:
    """A zstandard dictionary of identifiers: the parts of standard names, joined in the usual four styles.

    Names are those that the modules' sources define or use as attributes, so
    they don't depend on what else this process has loaded.
    """
    names = set(keyword.kwlist) | set(sys.stdlib_module_names)
    for m in MODULES:
        at = Path(sysconfig.get_path("stdlib"), *m.split("."))
        source = at / "__init__.py" if at.is_dir() else at.with_name(f"{at.name}.py")
        names |= {a or b for a, b in NAME.findall(source.read_text(encoding="utf-8"))}
    parts = sorted({w.lower() for n in names for w in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", n)})
    pick = random.Random(0)

    def name() -> str:
        w = pick.choices(parts, k=pick.randrange(1, 5))
        return ("_".join(w), w[0] + "".join(x.title() for x in w[1:]), "-".join(w), "_".join(w).upper())[pick.randrange(4)]

    samples = [" ".join(name() for _ in range(8)).encode() for _ in range(3000)] + [x for x in IDENTIFIERS.splitlines() if x] * 4
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()


class Novelty:
    def __init__(self, trained: bytes | None = None):
        primed = zstandard.ZstdCompressionDict(trained or dictionary(), dict_type=zstandard.DICT_TYPE_FULLDICT)
        primed.precompute_compress(level=LEVEL)
        self.of = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __call__(self, before: str, candidate: str, after: str) -> float:
        """Marginal compressed bytes a character, against the code around the candidate."""
        around = f"{FILL if len(before) + len(after) < AROUND else ''}{before}\n{after}\n".encode()
        shown = candidate.lower() if candidate.isupper() or CAMEL.fullmatch(candidate) else candidate
        return (len(self.of(around + shown.encode())) - len(self.of(around))) / len(candidate)


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Context:
    """Groups of places in sensitive context, asked for in rising order; each line is read once.

    None: not in sensitive context. A place behind a word on its line is a group of its own;
    the values in a PEM key, or on the lines after a label, are one.
    """

    def __init__(self, low: str):
        self.low, self.at, self.stop = low, 0, self._end(low, 0)
        self.label: int | None = None  # start of the sensitive line that a value on this line belongs to
        self.value: bool | None = None
        self.keys = []
        for m in PEM.finditer(low) if "private key" in low else ():
            end = PEM_END.search(low, m.start(), m.end())
            self.keys.append((m.start(), end.start() if end else m.end()))

    @staticmethod
    def _end(low: str, at: int) -> int:
        stop = low.find("\n", at)
        return len(low) if stop < 0 else stop

    def _only_value(self) -> bool:
        if self.value is None:
            self.value = bool(VALUE_LINE.fullmatch(self.low, self.at, self.stop))
        return self.value

    def _next_line(self) -> None:
        tail = self.low[max(self.at, self.stop - BEFORE) : self.stop]
        if any(w in tail for w in SENSITIVE) and not (self.stop - self.at >= 20 and self._only_value()):  # long values hold words by chance
            self.label = self.at
        elif tail.strip() and not self._only_value():
            self.label = None
        self.at, self.value = self.stop + 1, None
        self.stop = self._end(self.low, self.at)

    def __call__(self, a: int) -> tuple[str, int] | None:
        while a > self.stop:
            self._next_line()
        k = bisect_right(self.keys, (a, len(self.low))) - 1
        if k >= 0 and a < self.keys[k][1]:
            return "key", k
        if any(w in self.low[max(self.at, a - BEFORE) : a] for w in SENSITIVE):
            return "place", a
        return ("label", self.label) if self.label is not None and self._only_value() else None


def without(text: str, start: int, stop: int, places: list[int], size: int) -> str:
    """text[start:stop] less the strings of that size at these (sorted) places, whole or cut at either end."""
    out, stop = [], min(stop, len(text))
    for k in range(bisect_right(places, start - size), bisect_left(places, stop)):
        if places[k] > start:
            out.append(text[start : places[k]])
        start = max(start, places[k] + size)
    out.append(text[start:stop])
    return "".join(out)


def novel_spans(text: str, low: str, known: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    if len(low) != len(text) or not any(w in low for w in SENSITIVE):  # lower() may change lengths; positions have to agree
        if len(low) == len(text):
            return []
        low = "".join(c.lower() if c.isascii() else c for c in text)
    starts, ends = [], []
    for x, _, y in sorted(known):  # the furthest end of the base spans up to each start
        starts.append(x)
        ends.append(max(y, ends[-1]) if ends else y)
    found, places, groups = [], {}, {}
    sensitive = Context(low)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        s = m[0]
        before = bisect_left(starts, b)
        if s.isdigit() or (before and ends[before - 1] > a):
            continue
        group = sensitive(a)
        if group:
            found.append((a, b, group))
            places.setdefault(s, []).append(a)
            groups.setdefault(group, []).append((a, b))
    around = lambda a, b: (text[max(0, a - AROUND) : a], text[b : b + AROUND])
    whole = {}  # is the group, as one value, novel?
    for group, spans in groups.items():
        if len(spans) > 1:
            before, after = around(spans[0][0], spans[-1][1])
            whole[group] = novelty(before, "".join(text[a:b] for a, b in spans), after) >= MIN_NOVELTY
    out = []
    for a, b, group in found:
        s = text[a:b]
        if not whole.get(group):
            before, after = (without(text, x, y, places[s], b - a) for x, y in ((max(0, a - AROUND), a), (b, b + AROUND)))
            if novelty(before, s, after) < MIN_NOVELTY:
                continue
        out.append((a, 3, b))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """docs plus n_assign, n_access, n_hex, n_novel, base_sha256, spans."""

    trained = dictionary()

    def run(texts):
        novelty = Novelty(trained)
        for raw in texts:
            text = raw.decode() if raw else ""
            low = text.lower()
            base = base_spans(text, low)
            novel = novel_spans(text, low, base, novelty) if text else []
            count = [sum(k == x for _, x, _ in base) for k in range(3)]
            yield *count, len(novel), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + novel)

    long, text = T.LongType(), T.StringType()
    return add_columns(docs, ["text"], run, [("n_assign", long), ("n_access", long), ("n_hex", long), ("n_novel", long), ("base_sha256", text), ("spans", text)])
