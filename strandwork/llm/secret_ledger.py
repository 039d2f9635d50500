"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by its SHA-256.  The ledger is a table of
(blob, rule_version) pairs that were scanned and a table of their findings; a
scan reads only texts whose pair is in neither the ledger nor an earlier row of
the same input, and findings are joined back to every path (document) that holds
the blob.  One path stands for each new blob: the least, by a pre-aggregated
minimum, so thousands of copies cost one scan and no group is gathered.

Rules: the three base patterns, and more kinds that only add spans: private key
blocks (up to their END line, or to the end of a text without one), vendor token
formats, JSON web tokens, and passwords within URLs.  Spans of added kinds may
overlap base spans; redact() cuts out their union.

Nulls: a null text is an empty one; a null id is a path like any other.  Repeated
rows give repeated results.  Empty tables give empty results.  Extra columns are
kept by redact() and ignored by scan().
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small, small_batches, stored

#: Changes whenever a pattern does, so ledgers keep findings of different rules apart.
RULE_VERSION = "3"

# The base patterns of the contract and public formats of vendor tokens.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MORE = (
    ("private_key", "PRIVATE KEY", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)),
    ("github", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", "xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", "eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("google", "AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    ("stripe", "_live_", re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}")),
    ("url_login", "://", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/@]+@")),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in _MORE))
_ORDER = {k: i for i, k in enumerate(KINDS)}


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    base = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    more = []
    for kind, hint, pattern in _MORE:
        if hint in text:
            more += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return sorted(base + more, key=lambda s: (s[0], _ORDER[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_FOUND = "blob string, spans string, n_assign long, n_access long, n_hex long, base_sha256 string"


class Ledger:
    """Scanned (blob, rule_version) pairs with their findings, as Parquet below one folder; scans append to it."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.parts: list[str] = []

    def refresh(self, spark: SparkSession) -> None:
        """Takes in the whole parts that other sessions wrote."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/part-*/_SUCCESS")
        for status in found.getFileSystem(conf).globStatus(found) or []:
            part = f"{self.path}/{status.getPath().getParent().getName()}"
            if part not in self.parts:
                self.parts.append(part)

    def findings(self, spark) -> DataFrame:
        if not self.parts:
            return spark.createDataFrame([], _FOUND + ", rule_version string")
        return spark.read.schema(_FOUND + ", rule_version string").parquet(*self.parts)

    def append(self, found: DataFrame) -> None:
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        found.withColumn("rule_version", F.lit(RULE_VERSION)).write.parquet(part)
        self.parts.append(part)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """(doc_id, blob, spans, n_assign, n_access, n_hex, base_sha256) for every row of docs; the ledger gets what was new."""
    spark = small_batches(docs).sparkSession
    ledger = ledger or Ledger(new_path(spark, "ledger"))
    ledger.refresh(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    paths = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("blob")), "paths")
    seen = ledger.findings(spark).where(F.col("rule_version") == RULE_VERSION).select("blob")
    fresh = paths.groupBy("blob").agg(F.min("doc_id").alias("path"))
    if ledger.parts:
        fresh = fresh.join(seen, "blob", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()  # of this task's partition: rows repeated with id and text lie in one, and are scanned once
        for b in batches:
            out: list[tuple] = []
            for blob, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if blob in done:
                    continue
                done.add(blob)
                spans = find(t.as_py())
                if spans:
                    base = [s for s in spans if s[2] in ("assign", "access", "hex")]
                    n = [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
                    out.append((blob, joined(spans), *n, hashlib.sha256(joined(base).encode()).hexdigest()))
                else:
                    out.append((blob, "", 0, 0, 0, EMPTY_SHA))
            names = ["blob", "spans", "n_assign", "n_access", "n_hex", "base_sha256"]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    texts = docs.select(F.sha2(text.cast("binary"), 256).alias("blob"), F.col(id_col).cast("long").alias("__id"), text.alias("text"))
    # a null id stands for a blob only if no other path does, hence the null-safe join
    unscanned = texts.join(fresh.withColumnRenamed("blob", "__blob").hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("path")) & (F.col("blob") == F.col("__blob")), "left_semi")
    ledger.append(unscanned.select("blob", "text").mapInArrow(run, _FOUND).dropDuplicates(["blob"]))
    found = ledger.findings(spark).where(F.col("rule_version") == RULE_VERSION).drop("rule_version")
    hits = found.where("spans <> ''").dropDuplicates(["blob"])  # two sessions may have scanned a blob at the same time
    blank = {"spans": F.lit(""), "base_sha256": F.lit(EMPTY_SHA), "n_assign": F.lit(0), "n_access": F.lit(0), "n_hex": F.lit(0)}
    back = paths.join(hits, "blob", "left")
    return back.select("doc_id", "blob", *[F.coalesce(F.col(c), blank[c].cast("string" if c in ("spans", "base_sha256") else "long")).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every found span replaced; the same columns and rows."""
    found = scan(docs, id_col, text_col, ledger).where("spans <> ''").select("blob", "spans").distinct()
    found = small(stored(found.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans")), "found"))
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)

    @F.pandas_udf("string")
    def cut(text, spans):  # noqa: ANN001, ANN202
        def one(t: str, s: str | None) -> str:
            if not s or t is None:
                return t
            out, at = [], 0
            for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in s.split(",")):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return text.combine(spans, one)

    rows = docs.select(F.struct("*").alias("__row"), blob.alias("__key"))
    both = rows.join(found, F.col("__key") == F.col("__blob"), "left")
    text = F.when(F.col("__spans").isNull(), F.col("__row").getField(text_col)).otherwise(cut(F.col("__row").getField(text_col), F.col("__spans")))
    return both.select(*[(text if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns])
