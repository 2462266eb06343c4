"""The engine's logical tables, as views over Parquet tables of other shapes.

documents stand for items and their contents, events for signals, interactions
and usage, labels for triage, embeddings for passages' vectors. NOW is a
parameter of every query that needs a clock.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line, word_count
from ..operators import retrieval
from ..operators.storage import fingerprint, new_folder

_INDEXES: dict[tuple[str, str], str] = {}
NOW = "2024-01-31 00:00:00"
EPOCH = "2024-01-01"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def days(n) -> F.Column:
    return F.expr(f"make_dt_interval({n})") if isinstance(n, (int, str)) else F.make_dt_interval(n)


@dataclass(frozen=True)
class Views:
    spark: SparkSession
    path: str

    def raw(self, name: str) -> DataFrame:
        """A table. Texts in fewer pieces than there are cores (a small file can be a single row group) are dealt out first; larger tables never are."""
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df

    @cached_property
    def items(self) -> DataFrame:
        seen = now() - days("int(doc_id % 60)")
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.expr("CASE WHEN doc_id % 4 = 0 THEN 'paper' ELSE 'article' END").alias("kind"),
            first_line(F.col("text")).alias("title"), F.substring("text", 1, 1000).alias("summary"), F.col("lang"),
            F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/p/"), F.col("doc_id").cast("string")).alias("url"),
            seen.alias("first_seen"), F.when(F.col("doc_id") % 7 != 0, seen - days("int(doc_id % 120)")).alias("published_at"),
            F.expr("CASE WHEN doc_id % 4 < 2 THEN doc_id div 4 END").alias("paper_key"))

    @cached_property
    def contents(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"), word_count(F.col("text")).alias("words"), F.expr("CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'ok' END").alias("status"))

    @cached_property
    def interactions(self) -> DataFrame:
        action = F.expr("CASE event_type WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'like' WHEN 'signup' THEN 'save' WHEN 'error' THEN 'hide' ELSE 'view' END")
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), action.alias("action"), "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))

    @cached_property
    def signals(self) -> DataFrame:
        by = self.interactions.groupBy("item_id", F.to_date("ts").alias("observed_on"))
        return by.agg(F.nullif(F.count_if(F.col("action") == "view"), F.lit(0)).alias("upvotes"), F.nullif(F.count_if(F.col("action") == "open"), F.lit(0)).alias("upvotes7d"), F.count_if(F.col("action") == "like").alias("comments"))

    @cached_property
    def item_state(self) -> DataFrame:
        on = lambda a: F.count_if(F.col("action") == a) % 2 == 1
        opened = F.col("action") == "open"
        return self.interactions.groupBy("item_id").agg(
            F.min(F.when(opened, F.col("ts"))).alias("read_at"), F.max(F.when(opened, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)))).alias("read_progress"),
            on("like").alias("liked"), on("save").alias("saved"), on("hide").alias("hidden"))

    @cached_property
    def triage(self) -> DataFrame:
        return self.raw("labels").join(self.raw("documents").select("doc_id", "lang", "source"), "doc_id").select(
            F.col("doc_id").alias("item_id"), F.expr("quality * 6 + doc_id % 4").cast("int").alias("relevance"), F.array("lang", "source").alias("tags"),
            F.expr("filter(array(CASE WHEN toxic = 1 THEN 'promo' END, CASE WHEN doc_id % 9 = 0 THEN 'thin' END, CASE WHEN doc_id % 10 = 0 THEN 'off_topic' END), x -> x IS NOT NULL)").alias("flags"))

    @cached_property
    def digests(self) -> DataFrame:
        days_of = self.items.where("id % 5 = 0").select(F.col("id").alias("item_id"), F.to_date("first_seen").alias("day"), F.expr("double(id % 97) / 97").alias("final_score"))
        return days_of.unionByName(days_of.where("item_id % 10 = 0").select("item_id", F.date_add("day", 1).alias("day"), F.expr("double(item_id % 89) / 89").alias("final_score")))

    @cached_property
    def sources(self) -> DataFrame:
        kind = F.expr("CASE int(substring(source, 4)) % 4 WHEN 0 THEN 'hf_papers' WHEN 1 THEN 'hf_blog' WHEN 2 THEN 'hf_community' ELSE 'rss' END")
        return self.raw("documents").select("source").distinct().select(F.col("source").alias("id"), F.concat(F.lit("Source "), F.substring("source", 4, 9)).alias("name"), kind.alias("recipe_type"), F.expr("CASE WHEN int(substring(source, 4)) % 3 = 0 THEN 'builtin' ELSE 'user' END").alias("origin"), F.expr("int(substring(source, 4)) % 6 <> 5").alias("enabled"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label", F.expr("CASE WHEN vec_id % 3 = 0 THEN 'archive' ELSE 'content' END").alias("collection"), F.date_sub(F.lit(NOW[:10]).cast("date"), F.expr("int(vec_id % 60)")).alias("published_day"), F.when(F.col("vec_id") % 4 == 1, F.date_sub(F.lit(NOW[:10]).cast("date"), F.expr("int(vec_id % 90)"))).alias("read_day"))

    @cached_property
    def index(self) -> retrieval.Index:
        """The documents' postings: written once for each state of the table, then read."""
        what = (self.spark.sparkContext.applicationId, fingerprint(self.spark, f"{self.path}/documents.parquet"))
        if what not in _INDEXES:
            folder = new_folder(self.spark, "postings")
            retrieval.write_index(self.raw("documents"), "doc_id", F.col("text"), folder)
            _INDEXES[what] = folder
        return retrieval.open_index(self.spark, _INDEXES[what])

    @cached_property
    def passages(self) -> DataFrame:
        """Passages with what a search filters by; two neighbouring ids are passages of one item."""
        of = self.raw("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.expr("CASE WHEN doc_id % 4 = 0 THEN 'paper' ELSE 'article' END").alias("kind"))
        return self.vectors.join(of, "chunk_id").withColumn("item_id", F.expr("chunk_id - chunk_id % 2"))

    @cached_property
    def usage(self) -> DataFrame:
        return self.interactions.select("id", "ts", F.to_date("ts").alias("day"), (F.col("k") * 100).cast("long").alias("tokens_in"), (F.col("k") * 10).cast("long").alias("tokens_out"), (F.col("value") / 1000).alias("cost_usd"))


#: The same views for DuckDB, by name; each may use those before it.
VIEW_SQL: dict[str, str] = {
    "items": """SELECT doc_id AS id, source AS source_id, CASE WHEN doc_id % 4 = 0 THEN 'paper' ELSE 'article' END AS kind, substr(split_part(text, chr(10), 1), 1, 80) AS title, substr(text, 1, 1000) AS summary, lang,
        'https://' || source || '.example.org/p/' || doc_id AS url, TIMESTAMP '2024-01-31' - to_days((doc_id % 60)::INT) AS first_seen,
        CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-31' - to_days((doc_id % 60)::INT) - to_days((doc_id % 120)::INT) END AS published_at, CASE WHEN doc_id % 4 < 2 THEN doc_id // 4 END AS paper_key FROM documents""",
    "contents": """SELECT doc_id AS item_id, text AS body, len(regexp_extract_all(regexp_replace(text, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[\\pL\\pN]+(?:[''’-][\\pL\\pN]+)*'))::BIGINT AS words, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status FROM documents""",
    "interactions": """SELECT event_id AS id, user_id AS item_id, CASE event_type WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'like' WHEN 'signup' THEN 'save' WHEN 'error' THEN 'hide' ELSE 'view' END AS action, ts, value, json_extract(props, '$.k')::INT AS k FROM events""",
    "signals": """SELECT item_id, ts::DATE AS observed_on, nullif(count(*) FILTER (WHERE action = 'view'), 0) AS upvotes, nullif(count(*) FILTER (WHERE action = 'open'), 0) AS upvotes7d, count(*) FILTER (WHERE action = 'like') AS comments FROM interactions GROUP BY 1, 2""",
    "item_state": """SELECT item_id, min(ts) FILTER (WHERE action = 'open') AS read_at, max(least(1.0, greatest(0.0, value / 100))) FILTER (WHERE action = 'open') AS read_progress,
        count(*) FILTER (WHERE action = 'like') % 2 = 1 AS liked, count(*) FILTER (WHERE action = 'save') % 2 = 1 AS saved, count(*) FILTER (WHERE action = 'hide') % 2 = 1 AS hidden FROM interactions GROUP BY 1""",
    "triage": """SELECT l.doc_id AS item_id, (quality * 6 + l.doc_id % 4)::INT AS relevance, [lang, source] AS tags, list_filter([CASE WHEN toxic = 1 THEN 'promo' END, CASE WHEN l.doc_id % 9 = 0 THEN 'thin' END, CASE WHEN l.doc_id % 10 = 0 THEN 'off_topic' END], lambda x: x IS NOT NULL) AS flags FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "digests": """SELECT id AS item_id, first_seen::DATE AS day, (id % 97)::DOUBLE / 97 AS final_score FROM items WHERE id % 5 = 0 UNION ALL SELECT id, first_seen::DATE + 1, (id % 89)::DOUBLE / 89 FROM items WHERE id % 10 = 0""",
    "sources": """SELECT DISTINCT source AS id, 'Source ' || substr(source, 4, 9) AS name, CASE substr(source, 4)::INT % 4 WHEN 0 THEN 'hf_papers' WHEN 1 THEN 'hf_blog' WHEN 2 THEN 'hf_community' ELSE 'rss' END AS recipe_type, CASE WHEN substr(source, 4)::INT % 3 = 0 THEN 'builtin' ELSE 'user' END AS origin, substr(source, 4)::INT % 6 <> 5 AS enabled FROM documents""",
    "vectors": """SELECT vec_id AS chunk_id, embedding, label, CASE WHEN vec_id % 3 = 0 THEN 'archive' ELSE 'content' END AS collection, DATE '2024-01-31' - (vec_id % 60)::INT AS published_day, CASE WHEN vec_id % 4 = 1 THEN DATE '2024-01-31' - (vec_id % 90)::INT END AS read_day FROM embeddings""",
    "passages": """SELECT v.*, source AS source_id, CASE WHEN doc_id % 4 = 0 THEN 'paper' ELSE 'article' END AS kind, chunk_id - chunk_id % 2 AS item_id FROM vectors v JOIN documents ON doc_id = chunk_id""",
    "usage": """SELECT id, ts, ts::DATE AS day, k * 100 AS tokens_in, k * 10 AS tokens_out, value / 1000 AS cost_usd FROM interactions""",
    "latest_signals": """SELECT item_id, max(observed_on) AS observed_on, arg_max(struct_pack(u := upvotes, u7 := upvotes7d, c := comments), observed_on) AS s FROM signals GROUP BY 1""",
    "latest_digests": """SELECT item_id, max(day) AS day, arg_max(final_score, day) AS final_score FROM digests GROUP BY 1""",
    "listed": """SELECT i.id, i.source_id, i.kind, i.title, i.first_seen, i.published_at, coalesce(ls.s.u7, ls.s.u) AS popularity, ls.s.c AS comments, coalesce(st.liked, false) AS liked, coalesce(st.saved, false) AS saved, coalesce(st.hidden, false) AS hidden,
        st.read_at IS NOT NULL AS opened, coalesce(st.read_progress, 0) AS read_progress, c.words, CASE WHEN c.words > 0 THEN greatest(1, round_even(c.words / 230.0, 0)::INT) END AS minutes, ld.final_score AS score, t.relevance, coalesce(t.tags, []) AS tags, coalesce(t.flags, []) AS flags
        FROM items i LEFT JOIN item_state st ON st.item_id = i.id LEFT JOIN contents c ON c.item_id = i.id AND c.status = 'ok' LEFT JOIN latest_signals ls ON ls.item_id = i.id LEFT JOIN latest_digests ld ON ld.item_id = i.id LEFT JOIN triage t ON t.item_id = i.id""",
}
_USES = {"passages": ["vectors"], "signals": ["interactions"], "item_state": ["interactions"], "digests": ["items"], "usage": ["interactions"], "latest_signals": ["signals"], "latest_digests": ["digests"], "listed": ["items", "item_state", "contents", "latest_signals", "latest_digests", "triage"]}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """sql with the views it names, and those they use, as common table expressions before it."""
    need: list[str] = []

    def add(n: str) -> None:
        for d in _USES.get(n, []):
            add(d)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in need)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {body[5:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"
