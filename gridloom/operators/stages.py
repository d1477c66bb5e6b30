"""Named stages of a table with their steps, branches and fingerprints."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.edit import append_relaxed

Step = Callable[[DataFrame], DataFrame]


def _hashable(kind: T.DataType, column):
    """Maps as sorted entries, since Spark hashes no maps."""
    if isinstance(kind, T.MapType):
        return F.sort_array(F.map_entries(column))
    return column


def _sums(kind: T.StructType) -> list[Column]:
    """What a fingerprint is made of: sums over row hashes that no order changes."""
    hashes = F.xxhash64(*[_hashable(f.dataType, F.col(f"`{f.name}`")) for f in kind.fields], F.lit(0))
    return [F.count(F.lit(1)).alias("n"), F.sum(hashes.cast("decimal(38,0)")).alias("s"), F.bit_xor(hashes).alias("x")]


def _named(kind: T.StructType, sums: dict) -> str:
    return hashlib.md5(json.dumps([kind.jsonValue(), sums["n"], str(sums["s"]), sums["x"]], sort_keys=True).encode()).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """Of the schema and all rows, whatever their order: one aggregation of row hashes."""
    return _named(df.schema, df.agg(*_sums(df.schema)).first().asDict())


def _early_ends(df: DataFrame) -> int:
    """Operators in the plan that may stop reading their input, or read a part of it twice or not at all."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("extended")
    analyzed = text.getvalue().partition("== Analyzed Logical Plan ==")[2].partition("== Optimized Logical Plan ==")[0]
    return len(re.findall(r"(?m)^[ :+|-]*(?:GlobalLimit|LocalLimit|Offset|Tail|Join|Intersect|Except|Union)\b", analyzed))


def unchanged(before: DataFrame, after: DataFrame, proof: bool = False) -> bool:
    """By fingerprints, or with ``proof`` by comparing all rows both ways."""
    if before.columns != after.columns:
        return False
    if not proof:
        return fingerprint(before) == fingerprint(after)
    return before.exceptAll(after).limit(1).count() == 0 and after.exceptAll(before).limit(1).count() == 0


def schema_change(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    return {"added": [c for c in after.columns if c not in before.columns], "removed": [c for c in before.columns if c not in after.columns]}


@dataclass
class Record:
    """A step. input_fp and input_rows are of its input; they are known once the stage has been tracked."""

    text: str
    input_fp: str
    output_schema: dict[str, str]
    metadata: dict[str, str] = field(default_factory=dict)
    step: Step | None = None
    tracked: bool = False
    input_rows: int | None = None


@dataclass
class Stage:
    name: str
    df: DataFrame | None = None
    steps: list[Record] = field(default_factory=list)
    branches: list[str] = field(default_factory=list)
    parent: str | None = None
    parameters: dict[str, object] = field(default_factory=dict)
    #: The rows before the first step.
    source: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.source is None:
            self.source = self.df

    def schema(self) -> dict[str, str]:
        return dict(self.df.dtypes) if self.df is not None else {}

    def apply(self, step: Step | str, text: str = "", description: str | None = None, track: bool = True) -> DataFrame:
        """Run a callable, or SQL over ``{df}`` with the stage's parameters bound, and record it. Nothing is computed here: the fingerprints
        of inputs that ``track`` asks for come with the next run of ``track()``."""
        if self.df is None:
            raise ValueError("No data loaded")
        if isinstance(step, str):
            text = text or step
            sql, bound = step, dict(self.parameters)
            step = lambda df, sql=sql, bound=bound: df.sparkSession.sql(sql, args=bound or None, df=df)
        out = step(self.df)
        if not isinstance(out, DataFrame):
            raise ValueError("A step must return a DataFrame")
        self.steps.append(Record(text, "", dict(out.dtypes), {"description": description} if description else {}, step, track))
        self.df = out
        return out

    def track(self, run: Callable[[DataFrame], None] | None = None) -> list[str]:
        """Fingerprints of the inputs of all tracked steps, as by-products of one run over the stage's rows: ``run`` gets the rows and must
        read them all (by default nothing is kept of them), so a caller's own write pays for all of them.

        Before a step that may not read its whole input, as a limit or a join, the rows so far are read by a run of their own."""
        write = run or (lambda df: df.write.format("noop").mode("overwrite").save())
        df, waiting = self.source, []

        def filled() -> None:
            for record, seen, kind in waiting:
                record.input_fp, record.input_rows = _named(kind, seen.get), seen.get["n"]
            waiting.clear()

        if run is None and not any(r.tracked and not r.input_fp for r in self.steps):
            return [r.input_fp for r in self.steps]
        for record in self.steps:
            if record.tracked and not record.input_fp:
                seen = Observation(f"step-{uuid.uuid4().hex}")
                waiting.append((record, seen, df.schema))
                df = df.observe(seen, *_sums(df.schema))
            out = record.step(df)
            if waiting and _early_ends(out) > _early_ends(df):
                df.write.format("noop").mode("overwrite").save()
                filled()
            df = out
        if waiting or run is not None:
            write(df)
            filled()
        return [r.input_fp for r in self.steps]

    def replay(self, df: DataFrame) -> DataFrame:
        """The recorded steps over another input, as one lazy plan."""
        for record in self.steps:
            if record.step is not None:
                df = record.step(df)
        return df


class Workbook:
    """Stages by name, each a temporary view too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stages, self.current = spark, {}, None

    def _register(self, stage: Stage) -> Stage:
        if stage.name in self.stages:
            raise ValueError(f"Sheet '{stage.name}' already exists")
        self.stages[stage.name] = stage
        self.current = self.current or stage.name
        if stage.df is not None:
            stage.df.createOrReplaceTempView(stage.name)
        return stage

    def add(self, name: str, df: DataFrame | None = None) -> Stage:
        return self._register(Stage(name, df))

    def get(self, name: str) -> Stage:
        if name not in self.stages:
            raise ValueError(f"Sheet '{name}' not found")
        return self.stages[name]

    def apply(self, name: str, step: Step | str, text: str = "", description: str | None = None, track: bool = True) -> DataFrame:
        out = self.get(name).apply(step, text, description, track)
        out.createOrReplaceTempView(name)
        return out

    def branch(self, name: str, new: str) -> Stage:
        source = self.get(name)
        if new in self.stages:
            raise ValueError(f"Sheet '{new}' already exists")
        if source.df is None:
            raise ValueError("No data to branch")
        source.branches.append(new)
        return self._register(Stage(new, source.df, list(source.steps), [], name, dict(source.parameters), source.source))

    def paste(self, name: str, rows: DataFrame, mode: str = "replace") -> Stage:
        """Pasted rows take the place of a sheet's, whose steps end with them, go behind them as a step, or are a ``new`` sheet."""
        if mode == "new":
            return self.add(name, rows)
        stage = self.get(name)
        if mode == "append":
            if stage.df is None:
                raise ValueError("No data to append to")
            self.apply(name, lambda df: append_relaxed(df, rows), "paste")
        elif mode == "replace":
            stage.df, stage.source, stage.steps = rows, rows, []
            rows.createOrReplaceTempView(name)
        else:
            raise ValueError(f"Unknown mode: {mode}")
        return stage

    def remove(self, name: str) -> None:
        gone = self.get(name)
        if gone.parent in self.stages:
            self.stages[gone.parent].branches.remove(name)
        del self.stages[name]
        self.spark.catalog.dropTempView(name)
        if self.current == name:
            self.current = next(iter(self.stages), None)

    def lineage(self) -> DataFrame:
        """(sheet, step, text, input_fp, output_schema, metadata) of all steps; tracks the stages that have not been."""
        for stage in self.stages.values():
            if stage.source is not None:
                stage.track()
        rows = [(s.name, k, r.text, r.input_fp, r.output_schema, r.metadata) for s in self.stages.values() for k, r in enumerate(s.steps, 1)]
        return self.spark.createDataFrame(rows, "sheet string, step int, text string, input_fp string, output_schema map<string,string>, metadata map<string,string>")
