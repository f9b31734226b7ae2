"""The code-knowledge tables, drawn from the order, event and document tables at hand.

Each is one SELECT in the SQL that Spark and DuckDB share ({arr} is the array
constructor, {name} another table), so a plan and its check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DERIVED = {
    # parts are functions; their brand is the file
    "functions": """
        SELECT p_partkey AS id, p_name AS name, p_brand AS file_id, p_type AS kind, p_size AS complexity,
               CAST(p_partkey % 40 + 1 AS INT) AS start_line, CAST(p_partkey % 40 + p_size AS INT) AS end_line,
               p_partkey % 2 = 0 AS is_exported, p_partkey % 3 = 0 AS is_async, p_retailprice AS price,
               CASE WHEN p_type = 'ECONOMY' THEN 'infrastructure' WHEN p_partkey % 4 = 0 THEN 'domain' ELSE 'other' END AS layer
        FROM {part}""",
    "files": """
        SELECT p_brand AS id, concat('src/', CASE WHEN length(p_brand) = 7 THEN 'core' ELSE 'app' END, '/m', substr(p_brand, 7), '/index.ts') AS path,
               CASE WHEN count(*) % 3 = 0 THEN 'python' WHEN count(*) % 3 = 1 THEN 'typescript' ELSE 'go' END AS language,
               CAST(SUM(p_size) * 100 AS BIGINT) AS size, count(*) AS members
        FROM {part} GROUP BY p_brand""",
    # consecutive lines of an order call each other
    "calls": """
        SELECT a.l_partkey AS from_id, b.l_partkey AS to_id, CAST(max(b.l_linenumber) AS INT) AS line_number, max(b.l_quantity) >= 25 AS is_await
        FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_returnflag = 'R' AND a.l_quantity >= 30 AND a.l_partkey <> b.l_partkey
        GROUP BY a.l_partkey, b.l_partkey""",
    "imports": """
        SELECT f.file_id AS from_id, t.file_id AS to_id, count(*) AS weight
        FROM {calls} c JOIN {functions} f ON c.from_id = f.id JOIN {functions} t ON c.to_id = t.id
        WHERE f.file_id <> t.file_id AND (f.id + t.id) % 50 = 0 GROUP BY f.file_id, t.file_id""",
    "externals": """
        SELECT l_partkey AS from_id, s_name AS package, count(*) AS uses FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
        WHERE l_returnflag = 'A' AND l_quantity >= 45 GROUP BY l_partkey, s_name""",
    "ledger": """
        SELECT event_id AS seq, ts, CAST(event_id * 259 AS DOUBLE) AS at, user_id AS session_id, event_type,
               CASE WHEN event_type IN ('view', 'click') THEN 'query' WHEN event_type = 'purchase' THEN 'change' ELSE 'system' END AS source,
               value, {arr}(event_id % 97, event_id % 31) AS entity_ids,
               {arr}(concat('src/f', CAST(event_id % 53 AS STRING), CASE WHEN event_id % 17 = 0 THEN '.test.ts' WHEN event_id % 13 = 0 THEN '.config.ts' ELSE '.ts' END)) AS files
        FROM {events}""",
    "justifications": """
        SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 8 = 0 THEN 'General' ELSE source END AS feature, lang AS kind,
               concat(source, '/', lang) AS file_id, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS confidence, doc_id % 11 = 0 AS pending,
               CASE WHEN doc_id = 0 THEN NULL ELSE CAST(floor(doc_id / 4) AS BIGINT) END AS parent_id,
               {arr}(concat('t', CAST(doc_id % 5 AS STRING)), concat('t', CAST(doc_id % 7 AS STRING))) AS tags, n_chars, substr(text, 1, 80) AS summary
        FROM {documents}""",
    "commits": """
        SELECT p_brand AS module, concat('dev', CAST(l_suppkey % 9 AS STRING)) AS author, l_partkey AS entity, l_orderkey AS sha, l_quantity AS lines
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE (l_suppkey + l_partkey) % 5 = 0 AND l_suppkey % 9 * (length(p_brand) - 6) < 12""",
    "churn": "SELECT l_partkey AS id, count(*) AS changes FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY l_partkey",
    "callers": "SELECT to_id AS id, count(*) AS callers FROM {calls} GROUP BY to_id",
    "entity_facts": """
        SELECT f.id, f.name, f.file_id, f.layer, f.complexity, COALESCE(c.callers, 0) AS callers, COALESCE(h.changes, 0) AS changes,
               CASE WHEN f.id % 6 = 0 THEN NULL ELSE CAST((f.id * 37) % 101 AS DOUBLE) / 100 END AS confidence, concat('area ', CASE f.id % 5 WHEN 0 THEN 'payment' WHEN 1 THEN 'user' WHEN 2 THEN 'dashboard' ELSE 'misc' END) AS area
        FROM {functions} f LEFT JOIN {callers} c ON f.id = c.id LEFT JOIN {churn} h ON f.id = h.id""",
    # suppliers are classes and nations interfaces; the last line of an order is a method
    "classes": "SELECT s_suppkey AS id, s_name AS name, concat('Brand#', CAST(s_suppkey % 25 + 1 AS STRING)) AS file_id FROM {supplier}",
    "interfaces": "SELECT n_nationkey AS id, n_name AS name FROM {nation}",
    "extends": "SELECT s_suppkey AS from_id, s_suppkey % 5 AS to_id FROM {supplier} WHERE s_suppkey >= 5",
    "implements": "SELECT s_suppkey AS from_id, s_nationkey AS to_id FROM {supplier}",
    "has_method": "SELECT DISTINCT l_suppkey AS from_id, l_partkey AS to_id FROM {lineitem} WHERE l_linenumber = 7",
    "requests": """
        SELECT id, name, concat(CASE id % 12 WHEN 0 THEN 'who calls ' WHEN 1 THEN 'what does ' WHEN 2 THEN 'callers of ' WHEN 3 THEN 'where is ' WHEN 4 THEN 'how does '
               WHEN 5 THEN 'methods of ' WHEN 6 THEN 'classes that extend ' WHEN 7 THEN 'functions in ' WHEN 8 THEN 'similar to ' WHEN 9 THEN 'function '
               WHEN 10 THEN 'what uses ' ELSE 'Find ' END, name, CASE id % 12 WHEN 1 THEN ' call?' WHEN 4 THEN ' work' ELSE '' END) AS request
        FROM {functions}""",
    "asked": """
        SELECT id, concat(CASE id % 7 WHEN 0 THEN 'where is ' WHEN 1 THEN 'callers of ' WHEN 2 THEN 'How does ' WHEN 3 THEN 'class ' WHEN 4 THEN 'Where is ' ELSE '' END,
               name, CASE id % 7 WHEN 0 THEN ' defined' WHEN 4 THEN ' used?' WHEN 5 THEN ' overview' ELSE '' END) AS query
        FROM {functions}""",
    "hub": """
        SELECT from_id AS id FROM (SELECT from_id, count(*) AS n FROM {calls} GROUP BY from_id) x ORDER BY n DESC, from_id LIMIT 1""",
}


def needed(sql: str) -> list[str]:
    """Derived tables that a text names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name, body in DERIVED.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(" ".join(re.findall(r"\{(\w+)\}", body)))
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def oracle(sql: str) -> str:
    """The check's SQL with the derived tables that it names in front."""
    names = {n: n for n in [*RAW, *DERIVED]} | {"arr": "list_value"}
    ctes = [f"{n} AS ({DERIVED[n].format(**names)})" for n in needed(sql)]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        body, lead = body[len("WITH RECURSIVE") :], ","
    elif body.upper().startswith("WITH"):
        body, lead = body[len("WITH") :], ","
    else:
        lead = ""
    if not ctes:
        return sql.strip()
    return "WITH RECURSIVE " + ",\n".join(ctes) + (f"{lead}\n{body}" if lead else f"\n{body}")


class Tables:
    """``t.functions``, ``t.documents`` and so on, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.known:
            return self.known[name]
        if name in RAW:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in DERIVED:
            body = DERIVED[name]
            used = {n: self.__getattr__(n) for n in set(re.findall(r"\{(\w+)\}", body)) - {"arr"}}
            found = self.spark.sql(body.replace("{arr}", "array"), **used)
        else:
            raise AttributeError(name)
        self.known[name] = found
        return found

    def __call__(self, name: str) -> DataFrame:
        return getattr(self, name)
