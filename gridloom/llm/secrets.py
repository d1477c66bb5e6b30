"""Secret scans over a ledger of blobs.

Every text is a blob named by its SHA-256. The ledger is a Parquet table in the shared folder of (blob, scanned, spans): a run looks only
for pairs of a blob and a rule version that it doesn't hold, appends a row for each blob with such pairs (with or without findings), and
joins the findings of all blobs of the given texts back to every row that carries them. So copies and old versions of a text are scanned
once, and a new version of one rule scans with that rule alone. A text in which no rule's hint occurs can hold no span; its pairs are
entered without the text leaving its partition.

Spans are code points, end exclusive. Null texts are empty texts; texts are searched whole, however long; repeated rows are rows of their
own; other columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import batch_rows, shared_folder


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    flags: int = re.ASCII
    group: int = 0
    least: int = 1
    #: A pattern, in the part of the syntax that Java shares, that every text with a span holds; empty: always search.
    hint: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: The contract's base rules, in the order that it lists them.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, re.ASCII | re.IGNORECASE, 2, 6, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 1, re.ASCII, 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", 1, re.ASCII, 0, 24, r"[0-9a-f]{24}"),
)
#: The method's own rules come behind them. A private key reaches from its header to its end mark if only header lines and base64 runs
#: of 32 characters and more stand between, and a shorter one at most before the mark; else it is the header and the long runs that follow,
#: so that a mere mention hides no other text.
RULES = (
    *BASE,
    Rule("pem", rf"{_PEM}(?:(?:\s++(?:[A-Za-z][A-Za-z-]*+: [A-Za-z0-9,-]++(?=[\r\n])|[A-Za-z0-9+/=]{{32,}}+))*+(?:\s++[A-Za-z0-9+/=]{{1,31}}+)?+\s*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s++[A-Za-z0-9+/=]{{32,}}+)*+)", 3, re.ASCII, 0, 1, r"PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 2, re.ASCII, 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
)
LEDGER = "blob string, scanned array<string>, spans array<struct<rule:string,start:bigint,stop:bigint>>"


def find(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost spans that don't overlap; those whose group is too short go after the search."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for (blob, scanned, text, run), run being the numbers of the rules whose hint the text holds; the text is null if there
    is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            found = []
            for text, numbers in zip(batch.column("text"), batch.column("run")):
                text = text.as_py() if len(numbers) else ""
                found.append([{"rule": rules[k].name, "start": a, "stop": b} for k in numbers.as_py() for a, b in find(rules[k], compiled[k], text)])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("scanned"), pa.array(found, kind)], ["blob", "scanned", "spans"])

    return blobs.mapInArrow(run, LEDGER)


def _blob(text: str | Column = "text") -> Column:
    return F.sha2(F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8"), 256)


def update_ledger(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks and append it; returns the ledger. ``texts`` has a ``text`` column of any versions."""
    spark = texts.sparkSession
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    every = F.array(*[F.lit(r.name) for r in rules])
    run = F.array_compact(F.array(*[F.when(F.col("text").rlike(r.hint) if r.hint else F.lit(True), k) for k, r in enumerate(rules)]))
    rows = texts.select(_blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).withColumn("run", run)
    # only texts that may hold a span cross the shuffle that finds copies
    rows = rows.withColumn("text", F.when(F.size("run") > 0, F.col("text"))).dropDuplicates(["blob"])
    if known is None:
        todo = rows.withColumn("scanned", every)
    else:
        done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))  # as many as rules and versions
        todo = rows.join(done, "blob", "left").withColumn("scanned", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))).drop("done").filter(F.size("scanned") > 0)
        todo = todo.withColumn("run", F.filter("run", lambda k: F.array_contains("scanned", F.get(every, k))))
    with batch_rows(spark, 1000):
        scan(todo, rules).write.mode("append").option("compression", "zstd").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): for each blob with a span of these rule versions, all its spans (start, k, kind, stop) by start, then by rule."""
    number = lambda s: F.coalesce(*[F.when(s["rule"] == r.name, k) for k, r in enumerate(rules)])
    kind = lambda k: F.get(F.array(*[F.lit(r.kind) for r in rules]), k)
    spans = F.filter(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number(s).alias("k"), kind(number(s)).alias("kind"), s["stop"].alias("stop"))), lambda s: s["k"].isNotNull())
    rows = ledger.filter(F.size("spans") > 0).select("blob", spans.alias("found")).filter(F.size("found") > 0)
    # a blob and rule version comes twice only if two runs overlapped; the spans are the same then
    return rows.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))


_NONE = "array<struct<start:bigint,k:int,kind:string,stop:bigint>>"


def scan_texts(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found) for every row; found is empty where the text holds nothing."""
    ledger = ledger or f"{shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    found = findings(update_ledger(docs, ledger, rules), rules)
    paths = docs.select("doc_id", _blob().alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast(_NONE)).alias("found"))


def earlier(text: Column) -> Column:
    """A text as it was before its last third was written."""
    text = F.coalesce(text, F.lit(""))
    return F.substr(text, F.lit(1), F.length(text) - F.floor(F.length(text) / 3).cast("int"))


def history(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found, old_blob, old_found) for every row: findings in its text and in its earlier version, from one ledger.

    The earlier versions come first and meet the base rules alone; then the present texts meet all rules, where the ledger lacks them."""
    ledger = ledger or f"{shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    update_ledger(docs.select(earlier(F.col("text")).alias("text")), ledger, tuple(r for r in rules if r in BASE))
    found = findings(update_ledger(docs, ledger, rules), rules)
    paths = docs.select("doc_id", _blob().alias("blob"), _blob(earlier(F.col("text"))).alias("old_blob"))
    paths = paths.join(found, "blob", "left").join(found.select(F.col("blob").alias("old_blob"), F.col("found").alias("old_found")), "old_blob", "left")
    return paths.select("doc_id", "blob", "old_blob", *[F.coalesce(c, F.array().cast(_NONE)).alias(c) for c in ("found", "old_found")])


def digest(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = history(docs, ledger, rules)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = lambda spans: F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(joined(base("found")), "UTF-8"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "blob", "old_blob", joined(base("old_found")).alias("old_spans")
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars, where there is such a column, counted anew. Overlapping spans are one.

    Texts without findings, null ones too, stay as they are."""
    ledger = ledger or f"{shared_folder(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    found = findings(update_ledger(docs, ledger, rules), rules)
    step = lambda acc, s: F.when(s["stop"] <= acc["at"], acc).otherwise(
        F.struct(
            F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            s["stop"].alias("at"),
        )
    )
    clean = F.aggregate("__found", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"))))
    keyed = docs.withColumn("__blob", _blob()).join(found.select(F.col("blob").alias("__blob"), F.col("found").alias("__found")), "__blob", "left")
    changed = keyed.withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(*docs.columns)
