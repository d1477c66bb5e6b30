"""URL filters: a bit-parallel automaton runs all glob rules over each canonical URL at the same time.

A rule of a host is a pattern over ``.host`` + a mark + ``path`` as the contract cuts them; a glob's is over the canonical URL: host without
user, port and closing dots, then path and query, percent escapes of letters, digits and ``-._~`` undone, all in lower case, no fragment.
``*`` stands for any run. Every pattern has a bit for each of its symbols in a row of 64-bit words; one shift, mask and loop step by symbol
moves all patterns of all URLs of a block (Shift-And, stars as self-loops).

A null URL, or one without ``://``, has empty host and path; no rule of a host fits it, and globs see only the mark. Long URLs are run whole,
in blocks of bounded size. Of equally long rules the first in order decides. Repeated rows are judged each; columns but page_id and url,
whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands between host and path; no code point of a text has this number.
MARK = 0x110000
#: Words of state and code points that a block of URLs may hold at once.
STATE_WORDS, BLOCK_POINTS = 1 << 21, 1 << 20


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains with paths that start with ``path``; or a ``glob`` over ``host/path``."""

    verdict: str
    host: str = ""
    path: str = ""
    glob: str = ""

    @property
    def name(self) -> str:
        return self.glob or f"{self.host}{self.path}"


#: The rules that the query's contract names.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: A choice of words of addresses that a training corpus leaves out, and where a glob looks for them; ``read_rules`` takes others.
WORDS = (
    "spam cheap-pills casino malware poker jackpot slots betting bingo payday-loan viagra cialis replica-watch escort xxx porn adult-dating "
    "hookup warez keygen crack-download torrent phishing clickbait free-money work-from-home crypto-giveaway forex-signals link-farm "
    "doorway popup-ads adserver tracking-pixel linkwheel spinbot scraper-site autoblog essay-mill fake-id counterfeit weight-loss-pills miracle-cure"
)
SHAPES = ("*.{}.*", "*-{}.*", "*.{}-*", "*/{}/*", "*/{}-*", "*-{}/*", "*={}&*")


def word_globs(words: Iterable[str] = WORDS.split(), shapes: tuple[str, ...] = SHAPES) -> tuple[Rule, ...]:
    """A block rule for each word in each shape."""
    return tuple(Rule("block", glob=shape.format(word)) for word in words for shape in shapes)


#: The method's own globs; they decide where no rule above fits.
GLOBS = tuple(Rule("block", glob=g) for g in ("*spam*", "*cheap-pills*", "*casino*", "*malware*", "*free-*-download*")) + word_globs()


def read_rules(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table (verdict, host, path, glob) that people keep, in its natural order of all columns; nulls are empty. It goes to every
    task as masks, so more than 100,000 rows are refused."""
    rows = table.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("verdict", "host", "path", "glob")]).distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("More than 100000 rules")
    return tuple(Rule(*r) for r in sorted(map(tuple, rows)))


class Automaton:
    """Patterns as bit masks; ``run`` gives for each URL the patterns that fit it, as a boolean matrix."""

    def __init__(self, patterns: list[list[int | None]]):
        """A pattern is a list of symbols; None is a star."""
        bits: list[tuple[int | None, bool]] = []  # symbol of each state, does the state loop
        first, last = [], []
        loops_first = []
        for pattern in patterns:
            start = len(bits)
            loops_first.append(bool(pattern) and pattern[0] is None)
            bits.append((None, loops_first[-1]))  # before the first symbol
            for symbol in pattern:
                if symbol is None:
                    bits[-1] = (bits[-1][0], True)
                else:
                    bits.append((symbol, False))
            first.append(start)
            last.append(len(bits) - 1)
        self.words = (len(bits) + 63) // 64 or 1
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        self.start, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        symbols = sorted({s for s, _ in bits if s is not None})
        self.symbols = np.array(symbols, np.int64)
        self.masks = np.zeros((len(symbols) + 1, self.words), np.uint64)  # the last row: any other symbol
        for at, (symbol, loop) in enumerate(bits):
            bit = np.uint64(1) << np.uint64(at % 64)
            if loop:
                self.loop[at // 64] |= bit
            if symbol is not None:
                self.masks[symbols.index(symbol), at // 64] |= bit
        for at in first:
            self.start[at // 64] |= np.uint64(1) << np.uint64(at % 64)

    def run(self, urls: list[np.ndarray]) -> np.ndarray:
        order = np.argsort([-len(u) for u in urls], kind="stable")
        lengths = np.array([len(urls[k]) for k in order])
        states = np.tile(self.start, (len(urls), 1))
        flat = np.concatenate([urls[k] for k in order]) if len(urls) else np.zeros(0, np.uint32)
        found = np.searchsorted(self.symbols, flat)
        found[found == len(self.symbols)] = 0
        classes = np.where(self.symbols[found] == flat, found, len(self.symbols)).astype(np.int32) if len(self.symbols) else np.zeros(len(flat), np.int32)
        begin = np.cumsum(lengths) - lengths
        one, top = np.uint64(1), np.uint64(63)
        for j in range(lengths[0] if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -j))  # URLs longer than j come first
            now = states[:live]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            states[:live] = (shifted & self.masks[classes[begin[:live] + j]]) | (now & self.loop)
        out = np.zeros((len(urls), len(self.last)), bool)
        out[order] = (states[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & one > 0
        return out

    def fits(self, urls: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
        """Numbers of the patterns that fit each URL, in blocks that the state words and the code points bound; one longer URL is a block."""
        rows, held, size = max(1, STATE_WORDS // self.words), [], 0
        for url in urls:
            if held and (len(held) >= rows or size + len(url) > BLOCK_POINTS):
                yield from map(np.flatnonzero, self.run(held))
                held, size = [], 0
            held.append(url)
            size += len(url)
        if held:
            yield from map(np.flatnonzero, self.run(held))


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    points = lambda text: [ord(c) for c in text]
    patterns = []
    for rule in rules:
        if rule.glob:
            # a glob may begin and end anywhere; the mark between host and path counts as nothing, so a star crosses it
            code = [None if c == "*" else ord(c) for c in rule.glob]
            patterns.append([*([] if code[0] is None else [None]), *code, *([] if code[-1] is None else [None])])
        else:
            patterns.append([None, *points("." + rule.host), MARK, *points(rule.path), None])
    return Automaton(patterns)


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL, as the contract cuts it."""
    pattern = r"^(?s).*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), upper, lower), F.regexp_extract(url, pattern, 2)


#: A percent escape of an unreserved character: letters, digits, ``-``, ``.``, ``_`` and ``~``.
_PLAIN = {f"%{ord(c):02x}": c for c in "abcdefghijklmnopqrstuvwxyz0123456789-._~"} | {f"%{ord(c):02x}": c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_ESCAPE = re.compile("|".join(sorted(_PLAIN)))


def canonical(url: str) -> tuple[str, str]:
    """(host, path and query) for globs: ``//user@Host.:80/A%62?q#f`` behind a scheme is ``host`` and ``/ab?q``; empty without ``://``."""
    _, found, rest = url.partition("://")
    rest = _ESCAPE.sub(lambda m: _PLAIN[m[0]], rest.partition("#")[0].lower()) if found else ""
    cut = min((k for k in map(rest.find, "/?") if k >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2]
    name, port, number = host.rpartition(":")
    return (name if port and (not number or number.isdecimal()) else host).rstrip("."), rest[cut:]


def decided(url: Column, host: Column, path: Column, rules: tuple[Rule, ...], globs: tuple[Rule, ...]) -> Column:
    """(rule, verdict, globs): the name and verdict of the longest rule that fits (of equal ones the first), null without; and the names of
    the globs that fit, comma-joined, null without. The plan holds no rule, so any number of them will do."""

    def coded(host: str, rest: str) -> np.ndarray:
        out = np.frombuffer(f".{host}\0{rest}".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        out[len(host) + 1] = MARK
        return out

    @F.pandas_udf("rule string, verdict string, globs string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        plain, wild = compile_rules(rules), compile_rules(globs)
        weight = np.array([-len(r.name) for r in rules])
        for urls, hosts, paths in parts:
            best = [int(k[np.argmin(weight[k])]) if len(k) else None for k in plain.fits(coded(h, p) for h, p in zip(hosts, paths))]
            wide = [",".join(globs[k].name for k in ks) or None for ks in wild.fits(coded(*canonical(u)) for u in urls)]
            names = [None if k is None else rules[k].name for k in best]
            verdicts = [None if k is None else rules[k].verdict for k in best]
            yield pd.DataFrame({"rule": names, "verdict": verdicts, "globs": wide}, index=hosts.index, dtype=object)

    return run(F.coalesce(url, F.lit("")), host, path)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[Rule, ...] = GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict, globs): the longest fitting rule decides (of equal ones the first), else the globs."""
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    found = parts.withColumn("by", decided(F.col("url"), F.col("host"), F.col("path"), rules, globs))
    verdict = F.coalesce("by.verdict", F.when(F.col("by.globs").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("by.globs", F.lit("")).alias("globs"))
