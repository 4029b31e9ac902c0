"""The index: register folders, ingest them, show neighbourhoods, set the threshold, commit to disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import scan
from .sources import files, store


class Index:
    """Verbs over one store of records. `code`: a column of the codes' words, of a paragraphs frame; shingles by default."""

    def __init__(self, spark: SparkSession, model: str = "shingles", dim: int = 0, code: Column | None = None):
        self.spark, self.code, self.about = spark, code, store.params(model, dim)
        self.mounts: dict[str, str] = {}
        self.counts: dict[str, dict] = {}
        self.scans = 0
        self._thresh = scan.threshold()
        self._parts: dict[str, DataFrame] = {}
        self.records: DataFrame = spark.createDataFrame([], store.SCHEMA)

    @property
    def thresh(self) -> int:
        return self._thresh

    @thresh.setter
    def thresh(self, n: int) -> None:
        self._thresh = scan.checked_threshold(n)

    def mount(self, name: str, root: str) -> None:
        """A name registered again takes the new root."""
        self.mounts[name] = root

    def build(self, name: str | None = None) -> DataFrame:
        """Ingest one folder or all; an unknown name, or a folder with nothing to add, is an error."""
        for n in [name] if name else list(self.mounts):
            if n not in self.mounts:
                raise KeyError(n)
            found, counts = files.folder(self.spark, self.mounts[n])
            self.counts[n] = counts.first().asDict()
            if not self.counts[n]["indexed"]:
                raise ValueError(f"nothing to index in {self.mounts[n]}")
            self._parts[n] = files.paragraphs_of(found)
        parts = list(self._parts.values())
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            self.records = store.records(rows.withColumn("timestamp", F.unix_timestamp("mtime")), self.code)
        return self.records

    def similar(self, digest: str) -> DataFrame:
        """The neighbourhood of a content hash."""
        self.scans += 1
        return scan.neighbourhood(self.records, digest, self._thresh)

    def read_back(self, near: DataFrame) -> DataFrame:
        """near with a line on where each text comes from, and the text; a message where its place isn't known."""
        content = files_content(self.spark, list(self.mounts.values()))
        j = near.join(content, "path", "left")
        piece = F.expr("decode(substring(content, cast(off as int) + 1, cast(len as int)), 'UTF-8')")
        return j.select(*near.columns, F.concat_ws(":", "path", "para").alias("source"), F.when((F.col("len") > 0) & F.col("content").isNotNull(), piece).otherwise("(no place in a file is known)").alias("text"))

    def commit(self, path: str) -> None:
        store.save(self.records, path, self.about)

    def load(self, path: str) -> DataFrame:
        """A committed store of the same model, dimension, width and seed."""
        self.records, _ = store.opened(self.spark, path, self.about)
        return self.records

    def stats(self) -> DataFrame:
        """(key, value) rows, and one for each folder."""
        rows = [("records", self.records.count()), ("scans", self.scans), ("threshold", self._thresh), *[(k, v) for k, v in self.about.items()]]
        rows += [(k, sum(c[k] for c in self.counts.values())) for k in ("indexed", "empty", "skipped")]
        rows += [(f"mount {n}", r) for n, r in self.mounts.items()]
        return self.spark.createDataFrame([(k, str(v)) for k, v in rows], "key string, value string")

    def control(self, lines: str) -> None:
        """Verbs in text, one a line; blank lines and those that begin with # do nothing; the first error stops."""
        for line in lines.splitlines():
            words = line.split()
            if not words or words[0].startswith("#"):
                continue
            verb, args = words[0], words[1:]
            call = {"mount": (self.mount, 2, 2), "index": (self.build, 0, 1), "similar": (self.similar, 1, 1), "thresh": (lambda n: setattr(self, "thresh", int(n)), 1, 1), "commit": (self.commit, 1, 1)}.get(verb)
            if call is None:
                raise ValueError(f"unknown verb {verb}")
            if not call[1] <= len(args) <= call[2]:
                raise ValueError(f"{verb} takes {call[1]} to {call[2]} words")
            call[0](*args)


def files_content(spark: SparkSession, roots: list[str]) -> DataFrame:
    out = None
    for r in roots:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(r).select("path", "content")
        out = df if out is None else out.unionByName(df)
    return out
