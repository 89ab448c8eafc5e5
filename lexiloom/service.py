"""The four requests of the server, over an immutable corpus and its prefix index.

The texts of answers, their words and their line ends are fixed values, as clients compare them.
"""

from __future__ import annotations

import functools
import resource
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexiloom.functions.scalars import clamp_n, leading_int, parse_query, percent_decode
from lexiloom.operators.render import render_rows
from lexiloom.operators.suggest import LENGTH, order, prefix_index
from lexiloom.sources import corpus as K


#: Answers kept for the corpus in use.
ANSWERS = 10_000


def difference_text(a: int, b: int) -> str:
    """The difference of two times in words, as functions.scalars.time_difference gives it."""
    d = abs(int(b) - int(a))
    if not d:
        return "just now"
    days = d // 86400
    out = f"{d % 86400 // 3600:02d}:{d % 3600 // 60:02d}:{d % 60:02d}"
    for n, shown, word in ((days, days % 7, "day"), (days // 7, days // 7 % 4, "day"), (days // 28, days // 28, "month")):
        if n:
            out = f"{shown} {word}{'s' * (shown > 1)} {out}"
    return out


@dataclass
class Response:
    status: int
    reason: str
    body: str
    headers: dict[str, str] = field(default_factory=lambda: {"Cache-Control": "no-cache"})


class SuggestService:
    """Imports write a new version beside the old one and then switch, so a failed import changes nothing."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        self.corpus: DataFrame | None = None
        self.index: DataFrame | None = None
        self.size, self.queries, self.building, self.started = 0, 0, False, time.time()
        self.answers = self.top

    def import_(self, file: str, limit: int = -1) -> Response:
        began = time.time()
        try:
            lines = K.read_lines(self.spark, file)
            if not K.size_in_bytes(self.spark, file):
                return Response(500, "Internal Server Error", "mmap(2) failed")
        except AnalysisException:
            return Response(404, "Not Found", f"The file '{file}' was not found")
        self.building = True
        try:
            version = f"{self.store}/{uuid.uuid4().hex}"
            n_lines, n_added = K.counts(lines, limit).first()
            K.write(K.parse(lines, limit), f"{version}/corpus")
            corpus = self.spark.read.schema(K.SCHEMA).parquet(f"{version}/corpus")
            prefix_index(corpus).repartitionByRange("prefix").sortWithinPartitions("prefix", "rank").write.parquet(f"{version}/index")
            self.corpus, self.index, self.size = corpus, self.spark.read.parquet(f"{version}/index"), n_added
            self.answers = functools.lru_cache(ANSWERS)(self.top)
        finally:
            self.building = False
        return Response(200, "OK", f"Successfully added {n_added}/{n_lines}records from '{file}' in {int(time.time() - began)}second(s)\n")

    def export(self, file: str) -> Response:
        if self.building:
            return Response(412, "Busy", "Busy\n")
        began = time.time()
        self.building = True
        try:
            K.export(self.corpus, file, single=not file.endswith("/"), spark=self.spark)
        except OSError as e:
            return Response(500, "Internal Server Error", f"{e}\n")
        finally:
            self.building = False
        return Response(200, "OK", f"Successfully wrote {self.size} records to output file '{file}' in {int(time.time() - began)}second(s)\n")

    def top(self, q: str, n: int) -> list[dict]:
        if self.corpus is None:
            return []
        if len(q) <= LENGTH:
            rows = self.index.where((F.col("prefix") == q) & (F.col("rank") <= n)).orderBy("rank")
        else:
            rows = self.corpus.where(F.col("phrase").startswith(q)).orderBy(*order())
        return [{"phrase": r.phrase, "score": r.weight, "snippet": r.snippet} for r in rows.limit(n).collect()]

    def suggest(self, q: str = "", n: str | None = None, kind: str | None = None, callback: str | None = None) -> Response:
        self.queries += 1
        if self.building:
            return Response(412, "Busy", "")
        q = q.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        out = Response(200, "OK", render_rows(q, self.answers(q, clamp_n(n or None)), kind, callback))
        out.headers["Content-Type"] = "text/plain; charset=UTF-8"
        return out

    def stats(self) -> Response:
        size = "Data Store is busy\n" if self.building else f"Data store size: {self.size} entries\n"
        memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
        return Response(200, "OK", f"Answered {self.queries} queries\nUptime: {difference_text(self.started, time.time())}\n{size}Memory usage: {memory} MiB\n")

    def handle(self, url: str) -> Response:
        parts = urlsplit(url)
        p = parse_query(parts.query)
        if parts.path == "/face/suggest/":
            return self.suggest(percent_decode(p.get("q", "")), p.get("n"), percent_decode(p.get("type", "")), percent_decode(p.get("callback", "")))
        if parts.path == "/face/import/":
            limit = leading_int(p.get("limit", ""))
            return self.import_(percent_decode(p.get("file", "")), limit if limit > 0 else -1)
        if parts.path == "/face/export/":
            return self.export(p.get("file", ""))
        if parts.path == "/face/stats/":
            return self.stats()
        return Response(404, "Not Found", "Sorry, but the page you requested could not be found\n")
