"""Secret scans with an incremental ledger of content-addressed blobs.

A blob is a text, addressed by its SHA-256; a path (a document, in one of its versions) points at one.
The ledger records which (blob, rule, rule version) have been scanned and what was found, so a run scans
only pairs that it has not seen, each once however many paths share the blob, and joins the findings back
to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh_dir, materialize, quoted

#: Blobs that may be broadcast (about 60 bytes each).
BROADCAST_BLOBS = 200_000


@dataclass(frozen=True)
class SecretRule:
    """All leftmost non-overlapping matches of `pattern`, of which those stay whose `group` has `least` characters.

    A change of pattern, group or length needs a new version, or blobs that were scanned stay unscanned.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    needles: tuple[str, ...] = ()  # a match holds one of these once the text is lower-cased; none: try all texts
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern))

    def __reduce__(self):
        return (SecretRule, (self.kind, self.version, self.pattern, self.least, self.group, self.needles))

    def spans(self, text: str, lowered: str) -> list[tuple[int, int]]:
        if self.needles and not any(n in lowered for n in self.needles):
            return []
        g = self.group
        return [m.span() for m in self.compiled.finditer(text) if m.end(g) - m.start(g) >= self.least]


#: Fixed patterns of the three base kinds, in their order. Runs of hex digits are maximal, so their length may
#: stand in the pattern; an access key's run cannot begin inside a shorter one either.
BASE_RULES = (
    SecretRule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, ("password", "passwd", "secret", "token", "api")),
    SecretRule("access", 1, r"AKIA[A-Z0-9]{12,}", 16, needles=("akia",)),
    SecretRule("hex", 1, r"[0-9a-f]{32,}", 32),
)

_PAIR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("version", T.IntegerType())])
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), *_PAIR.fields, T.StructField("spans", T.ArrayType(_SPAN))])


class BlobLedger:
    """A table of what was scanned and found: a row per (blob, kind, version), kept as Parquet in `path`, by kind and version.

    Batches only append. A batch that is lost half-written leaves no row (the writer commits at its end), and a
    batch that runs again finds its pairs seen.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_dir(spark, "secret-ledger")

    def read(self, rules: Sequence[SecretRule] | None = None, blobs: DataFrame | None = None) -> DataFrame:
        """The ledger's rows, or those of these rules and of these distinct blobs (blob) only."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(LEDGER).parquet(self.path)
        if rules is not None:  # on the columns of folders, so that other rules' files are not read
            rows = rows.where(reduce(Column.__or__, ((F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules), F.lit(False)))
        return rows if blobs is None else rows.join(_sided(blobs), "blob", "left_semi")

    def unseen(self, blobs: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
        """Of the distinct blobs (blob), those with a rule not yet applied: blob and `kinds`, the kinds to scan for."""
        wanted = F.array(*(F.lit(r.kind) for r in rules)).cast("array<string>")
        have = self.read(rules, blobs).groupBy("blob").agg(F.collect_set("kind").alias("have"))
        left = blobs.join(have, "blob", "left")
        todo = F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>")))
        return left.select("blob", todo.alias("kinds")).where(F.size("kinds") > 0)

    def scan(self, blobs: DataFrame, contents: DataFrame, rules: Sequence[SecretRule]) -> int:
        """Scan what is unseen of the distinct `blobs` (blob); `contents` has (blob, text), repeats and all. Returns the number of pairs scanned.

        Copies of a blob go down to one in each task before anything is shuffled, and only texts of unseen blobs
        are, or none at all if nothing is unseen.
        """
        todo = materialize(self.unseen(blobs, rules), "unseen")
        pairs, n = todo.agg(F.coalesce(F.sum(F.size("kinds")), F.lit(0)), F.count("*")).first()
        if not pairs:
            return 0
        if n <= BROADCAST_BLOBS:
            contents = contents.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
        once = contents.groupBy("blob").agg(F.first("text").alias("text"))
        found = once.join(todo, "blob").select("blob", "kinds", "text").mapInArrow(_scanner(rules), LEDGER)
        found.write.mode("append").partitionBy("kind", "version").parquet(self.path)
        return pairs


def _sided(blobs: DataFrame) -> DataFrame:
    return F.broadcast(blobs) if blobs.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS else blobs


def _scanner(rules: Sequence[SecretRule]):
    by_kind = {r.kind: r for r in rules}
    if len(by_kind) < len(rules):
        raise ValueError("a kind has two rules")
    arrow = pa.schema(
        [("blob", pa.binary()), ("kind", pa.string()), ("version", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for blob, kinds, text in zip(*batch.slice(at, 512).columns):
                    text = text.as_py()
                    lowered = text.lower()
                    for kind in kinds.as_py():
                        spans = [{"start": a, "end": b} for a, b in by_kind[kind].spans(text, lowered)]
                        rows.append({"blob": blob.as_py(), "kind": kind, "version": by_kind[kind].version, "spans": spans})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def scan_secrets(docs: DataFrame, rules: Sequence[SecretRule] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """One row per document: id_col and `findings`, an array of (start, kind, end) by start, then kind in rule order.

    Offsets are code points, the end exclusive. A null text is an empty one. Repeated rows are several paths to
    one blob, which is scanned once, and get equal results each; texts of different rows with one id are told apart
    by their blob, and null ids are paths like any other. Other columns are not read; an empty table gives an empty
    one. Without a `ledger` a new one is begun, so every blob is scanned once.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    blob = F.unhex(F.sha2("text", 256)).alias("blob")
    paths = materialize(source.select("id", blob), "paths")
    blobs = materialize(paths.select("blob").distinct(), "blobs")
    ledger.scan(blobs, source.select(blob, "text"), rules)

    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    hits = ledger.read(rules, blobs).where(F.size("spans") > 0).dropDuplicates(["blob", "kind"])
    span = F.explode("spans").alias("span")
    hits = hits.select("blob", "kind", span).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(F.col("span.start"), order[F.col("kind")].alias("nth"), "kind", F.col("span.end")))).alias("findings"))
    out = paths.join(hits, "blob", "left")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("nth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))
    return out.select(F.col("id").alias(id_col), F.coalesce("findings", F.array().cast(kind)).alias("findings"))
