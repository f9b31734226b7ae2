"""License scan: TF-IDF cosine to license templates, then inheritance down the directories.

Templates are notices and texts of licenses.  Header windows: every run of as many terms of
a text as a template has is compared with it, wherever it stands, so neither what is around
a notice nor how it is broken into lines matters.  Whole files: the text as a whole is
compared with every template.  Both are sparse TF-IDF cosines.  Document frequencies of
the templates' terms are counted over all texts; a term of no template weighs as much as
the rarest one of theirs that occurs.  So weights follow shares of the texts and not their
number, and a header is found among a thousand texts as among millions.

Only texts that can reach the threshold are looked at closely: a template's rarest terms,
taken until the others together can't reach it, are looked for first, which loses nothing
(the prefix filter of similarity joins).  A window is counted out only if a bound from sums
over it, which its exact cosine can't exceed, reaches the threshold.  What a text holds is
found once for each distinct text, by its MD5, so ids may be null and repeat.

A text whose best window reaches the threshold has that license.  A license file, by its
name or because the text as a whole reaches the threshold, gives its license to its
directory; where several do, the most similar, then the first path, then the first license.
A file with none of its own takes the one of the nearest directory above it.  Each directory
looks up its ancestors once, however many files it holds, and files look their directory up
in a table that is sent to them if it is small, else with each directory in several parts.

Terms are runs of a-z and 0-9, with inner dots and dashes, after A-Z have been lowered.
Equal similarities go to the first license by name.  Null and empty texts have no
license of their own and inherit like others; a null path has no directory.  Repeated rows
give repeated rows.  Columns besides id, path and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_texts, durable, if_few, release
from graphloom.llm.license_texts import TEMPLATES

THRESHOLD = 0.6
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: Parts of a directory whose rows would else meet in one task.
PARTS = 32

_TERM = re.compile(TERM.encode())
#: Letters lowered, digits, dots and dashes as they are, everything else a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if chr(c) in ".-0123456789" + LOWER else 32 for c in range(256))


def term_set(data: bytes) -> set[bytes]:
    """The distinct terms of a text, as ``terms`` finds them in a column."""
    runs = set(data.translate(_PLAIN).split())
    plain = {r for r in runs if r.isalnum()}
    plain.update(_TERM.findall(b" ".join(runs - plain)))
    return plain


def term_list(data: bytes) -> list[bytes]:
    return _TERM.findall(data.lower() if data.isascii() else data.translate(_LOWERED))


_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Weights:
    """The templates as vectors, from the document frequencies of their terms among n texts."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], n: int, threshold: float):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        counts = [Counter(t.decode() for t in term_list(text.encode())) for _, text in templates]
        self.lengths = [sum(c.values()) for c in counts]
        self.idf = {t: round(math.log((1 + n) / (1 + frequency.get(t, 0))) + 1, 9) for t in sorted(set().union(*counts))}
        self.foreign = max((v for t, v in self.idf.items() if frequency.get(t, 0)), default=1.0)
        self.place = {t.encode(): i for i, t in enumerate(self.idf)}
        each = np.array([*self.idf.values(), self.foreign])
        self.each = each
        self.unit = np.zeros((len(templates), len(each)))  # the last column is of foreign terms
        self.lookup: set[bytes] = set()
        for row, c in zip(self.unit, counts, strict=True):
            for t, k in c.items():
                row[self.place[t.encode()]] = k * self.idf[t]
            row /= np.sqrt((row**2).sum())
            left = 1.0
            for t in sorted(c, key=lambda t: (frequency.get(t, 0), t)):
                if left < threshold**2 * (1 - 1e-9):
                    break
                self.lookup.add(t.encode())
                left -= row[self.place[t.encode()]] ** 2

    def best(self, data: bytes) -> tuple[str | None, float | None, str | None, float | None]:
        """The license of the best window with its similarity, and that of the text as a whole."""
        terms = term_list(data)
        at = np.array([self.place.get(t, len(self.each) - 1) for t in terms], np.int64)
        windows, whole = [], []
        if not len(at):
            return None, None, None, None
        dots = self.unit * self.each
        squares = np.concatenate([[0.0], np.cumsum(self.each[at] ** 2)])
        # Foreign terms are told apart where they repeat; at stands for all of them.
        number = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        own = np.array([number[t] for t in terms], np.int64)
        present = np.bincount(at, minlength=len(self.each)) > 0
        for t, name in enumerate(self.names):
            if self.unit[t, present] @ self.unit[t, present] < self.threshold**2 * (1 - 1e-9):
                continue
            sums = np.concatenate([[0.0], np.cumsum(dots[t, at])])
            size = min(self.lengths[t], len(at))
            dot = sums[size:] - sums[:-size]
            bound = dot / np.sqrt(squares[size:] - squares[:-size])
            for start in np.flatnonzero(bound >= self.threshold - 1e-6).tolist():
                windows.append((-self._cosine(dot[start], at[start : start + size], own[start : start + size]), name))
            whole.append((-self._cosine(sums[-1], at, own), name))
        found = []
        for s, name in (min(windows, default=(0, None)), min(whole, default=(0, None))):
            found += [name, -s] if name is not None and -s >= self.threshold else [None, None]
        return tuple(found)

    def _cosine(self, dot: float, at: np.ndarray, own: np.ndarray) -> float:
        _, first, counts = np.unique(own, return_index=True, return_counts=True)
        return round(float(dot) / math.sqrt(float(((counts * self.each[at[first]]) ** 2).sum())), 6)


def frequencies(files: DataFrame, vocabulary: set[bytes]) -> tuple[dict[str, int], int]:
    """How many texts hold each term of the vocabulary, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for b in batches:
            found[b""] += b.num_rows
            for text in arrow_texts(b.column("text")):
                found.update(term_set(text or b"") & vocabulary)
            release()
        yield pa.RecordBatch.from_arrays(
            [pa.array([t.decode() for t in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"]
        )

    # A task sends one row a term.
    counted = {r.term: r.n for r in files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counted, counted.pop("", 0)


def holdings(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """key (MD5 of the text), name, similarity, whole and whole_similarity of the distinct texts that hold a license."""
    vocabulary = {t for _, text in templates for t in term_list(text.encode())}
    weights = Weights(templates, *frequencies(files, vocabulary), threshold)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            rows = []
            for key, text in zip(b.column("key").to_pylist(), arrow_texts(b.column("text")), strict=True):
                if text and key not in seen and not weights.lookup.isdisjoint(term_set(text)):
                    seen.add(key)  # of a small part of the texts
                    found = weights.best(text)
                    if found[0] or found[2]:
                        rows.append((key, *found))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64())
            names = ["key", "name", "similarity", "whole", "whole_similarity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            release()

    kind = "key string, name string, similarity double, whole string, whole_similarity double"
    return files.select(_key().alias("key"), "text").mapInArrow(find, kind).distinct()


def _key() -> F.Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def looked_up(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """A left join with a table of one row for each value: sent to the rows if it is small, else each value in parts."""
    table = durable(table)
    small = if_few(table)
    if small is not table:
        return rows.join(small, on, "left")
    parts = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    return rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).cast("int")).join(parts, [on, "_part"], "left").drop("_part")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """From id, path and text: id, own, similarity, is_file, directory it inherits from, license; a row for each row."""
    found = holdings(files, templates, threshold)
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    named = F.coalesce(F.regexp_like("path", F.lit(LICENSE_FILE)), F.lit(False))
    marked = durable(
        looked_up(files.select("id", "path", directory.alias("directory"), _key().alias("key")), found, "key")
        .withColumn("own", F.coalesce("name", "whole"))
        .withColumn("similarity", F.coalesce("similarity", "whole_similarity"))
        .withColumn("is_file", F.col("own").isNotNull() & (F.col("whole").isNotNull() | named))
        .select("id", "path", "directory", "own", "similarity", "is_file")
    )
    # The best license file of each directory: a bounded aggregate, combined before the shuffle.
    gives = (
        marked.filter("is_file AND directory IS NOT NULL")
        .groupBy(F.col("directory").alias("above"))
        .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "own")).alias("g"))
        .select("above", F.col("g.own").alias("given"))
    )
    parts = F.split("directory", "/")
    ancestors = (
        marked.select("directory")
        .filter("directory IS NOT NULL")
        .distinct()
        .select("directory", F.explode(F.sequence(F.lit(0), F.when(F.col("directory") == "", 0).otherwise(F.size(parts)))).alias("depth"))
        .withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    )
    nearest = (
        ancestors.join(gives, "above")
        .groupBy("directory")
        .agg(F.max_by(F.struct("above", "given"), "depth").alias("n"))
        .select("directory", F.col("n.above").alias("from"), F.col("n.given").alias("given"))
    )
    inherits = F.col("own").isNull() & F.col("given").isNotNull()
    return looked_up(marked, nearest, "directory").select(
        "id",
        "own",
        "similarity",
        "is_file",
        F.when(inherits, F.col("from")).alias("inherited_from"),
        F.coalesce("own", "given").alias("license"),
    )


def op6_license(spark, sf_dir: str) -> DataFrame:
    """Documents as files: the source is their directory, the language the one below it."""
    from graphloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    files = docs.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
        "text",
    )
    return scan(files).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    given = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    lower = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return rf"""
WITH files AS (
  SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, COALESCE(text, '') AS text, md5(COALESCE(text, '')) AS key FROM documents
), template AS (
  SELECT no, name, term, count(*) AS tf
  FROM (SELECT no, name, unnest(regexp_extract_all({lower.format("text")}, '{TERM}')) AS term FROM (VALUES {given}) t(no, name, text)) GROUP BY ALL
), size AS (SELECT no, CAST(sum(tf) AS BIGINT) AS m FROM template GROUP BY no),
total AS (SELECT count(*)::DOUBLE AS n FROM files), vocabulary AS (SELECT DISTINCT term FROM template),
listed AS (SELECT key, regexp_extract_all({lower.format("any_value(text)")}, '{TERM}') AS terms, count(*) AS texts FROM files GROUP BY key),
df AS (
  SELECT term, CAST(sum(texts) AS DOUBLE) AS df FROM (SELECT texts, unnest(list_distinct(terms)) AS term FROM listed)
  WHERE term IN (SELECT term FROM vocabulary) GROUP BY term
), idf AS (
  SELECT v.term, round(ln((1 + n) / (1 + COALESCE(df, 0))) + 1, 9) AS idf, df FROM vocabulary v LEFT JOIN df USING (term), total
), other AS (SELECT COALESCE(max(idf) FILTER (WHERE df > 0), 1.0) AS w FROM idf),
mass AS (SELECT no, name, term, tf * idf AS m FROM template JOIN idf USING (term)),
weight AS (SELECT no, name, term, m / sqrt(sum(m * m) OVER (PARTITION BY no)) AS w FROM mass),
heavy AS (
  SELECT no, term FROM (SELECT no, term, COALESCE(sum(w * w) OVER (PARTITION BY no ORDER BY COALESCE(df, 0), term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM weight JOIN idf USING (term))
  WHERE 1 - before >= {THRESHOLD * THRESHOLD * (1 - 1e-9)}
), seen AS (
  SELECT key, generate_subscripts(terms, 1) AS pos, unnest(terms) AS term, len(terms) AS n
  FROM listed WHERE list_has_any(terms, (SELECT list(DISTINCT term) FROM heavy))
), hit AS (
  SELECT DISTINCT key, no, LEAST(m, n) AS size, GREATEST(1, LEAST(pos - o, n - LEAST(m, n) + 1)) AS start
  FROM (SELECT key, no, m, n, pos, unnest(range(0, m)) AS o FROM seen JOIN heavy USING (term) JOIN size USING (no))
  UNION ALL SELECT DISTINCT key, no, n, 0 FROM seen JOIN heavy USING (term)
), tf AS (
  SELECT h.key, h.no, h.start, t.term, count(*) AS tf
  FROM hit h JOIN seen t ON h.key = t.key AND (h.start = 0 OR t.pos BETWEEN h.start AND h.start + h.size - 1) GROUP BY ALL
), close AS (
  SELECT tf.key, tf.no, start, round(sum(tf * idf * weight.w) / sqrt(sum((tf * COALESCE(idf, (SELECT w FROM other))) ** 2)), 6) AS similarity
  FROM tf LEFT JOIN idf USING (term) LEFT JOIN weight USING (no, term) GROUP BY tf.key, tf.no, start
), best AS (
  SELECT key, start = 0 AS whole, name, similarity, row_number() OVER (PARTITION BY key, start = 0 ORDER BY similarity DESC, name) AS r
  FROM close JOIN (SELECT DISTINCT no, name FROM template) USING (no) WHERE similarity >= {THRESHOLD}
), marked AS (
  SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS directory, COALESCE(o.name, w.name) AS own,
         COALESCE(o.similarity, w.similarity) AS similarity,
         COALESCE(o.name, w.name) IS NOT NULL AND (w.name IS NOT NULL OR regexp_matches(path, '{LICENSE_FILE}')) AS is_file
  FROM files
  LEFT JOIN (SELECT * FROM best WHERE r = 1 AND NOT whole) o USING (key)
  LEFT JOIN (SELECT * FROM best WHERE r = 1 AND whole) w USING (key)
), gives AS (
  SELECT directory AS above, own AS given FROM marked WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY similarity DESC, path, own) = 1
), nearest AS (
  SELECT m.directory, above, given FROM (SELECT DISTINCT directory FROM marked) m
  JOIN gives ON above = '' OR m.directory = above OR starts_with(m.directory, above || '/')
  QUALIFY row_number() OVER (PARTITION BY m.directory ORDER BY length(above) DESC) = 1
)
SELECT doc_id, own, similarity, is_file, CASE WHEN own IS NULL THEN above END AS inherited_from, COALESCE(own, given) AS license
FROM marked LEFT JOIN nearest USING (directory)
"""


OP6_SQL = _sql()
