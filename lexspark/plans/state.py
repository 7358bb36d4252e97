"""Merges, patches, cascades, views and pages over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions.notation import stripped, uuid_key
from lexspark.functions.vectors import is_vector
from lexspark.operators import store
from lexspark.operators.corpus import best_duplicate, carry_over, distinct_ids, drop_exact, resolve_keys
from lexspark.functions.text import without_year
from lexspark.plans.common import DIM, LAWS, current_laws, newest, trim, usable
from lexspark.sources.tables import table


def _old_and_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keys of the last delivery, and of the current list: law_key, origin, last_changed as written."""
    v = table(spark, d, "law_versions").withColumn("law_key", stripped(F.col("law_key"))).where(F.col("law_key").isNotNull())
    last = v.where(F.col("snap_no") == v.agg(F.max("snap_no")).scalar())
    old = store.unique(last, ["law_key"], [F.col("checked_at").desc_nulls_last(), F.col("id").desc()])
    new = table(spark, d, "laws").withColumn("law_key", stripped(F.col("law_key"))).where(F.col("law_key").isNotNull())
    new = store.unique(new, ["law_key"], [F.col("loaded_at").desc_nulls_last(), F.col("id").desc()])
    return old.select("law_key", F.lit("old").alias("origin"), "last_changed"), new.select("law_key", F.lit("new").alias("origin"), "last_changed")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery overwritten by the current list."""
    return store.upsert(*_old_and_new(spark, d), ["law_key"])


def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery with what only the current list has."""
    return store.insert_ignore(*_old_and_new(spark, d), ["law_key"])


def _marks(spark: SparkSession, d: str) -> DataFrame:
    norm = F.coalesce(stripped(F.col("norm_id")), F.lit(""))
    return table(spark, d, "bookmarks").withColumns({"law_key": stripped(F.col("law_key")), "norm_id": norm, "folder_id": uuid_key(F.col("folder_id"))})


def bookmark_sync(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks not yet synced, and those synced that they do not replace; of one user, law and norm the lowest id."""
    keys = ["user_id", "law_key", "norm_id"]
    marks = _marks(spark, d)
    one = lambda df: store.unique(df, keys, [F.col("id")])
    local, remote = one(marks.where(~F.col("synced"))), one(marks.where("synced"))
    return store.upsert(remote, local, keys).select(*keys, "id", "synced")


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """One bookmark for each user, law and norm."""
    return store.unique(_marks(spark, d), ["user_id", "law_key", "norm_id"], [F.col("id")]).select("id", "user_id", "law_key", "norm_id")


def title_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks with a title: their own, else the law's, else the key."""
    titles = store.unique(current_laws(spark, d).where(F.col("law_key").isNotNull()), ["law_key"], [F.col("law_id").desc()])
    marks = _marks(spark, d).select("id", "law_key", "law_title").distinct()
    joined = marks.join(titles.select("law_key", F.col("law_title").alias("t")), "law_key", "left")
    return joined.select("id", F.coalesce(stripped(F.col("law_title")), "t", "law_key").alias("title"))


def orphan_delete(spark: SparkSession, d: str) -> DataFrame:
    """Norms that remain when those of missing laws are deleted; norms without law stay."""
    norms = table(spark, d, "norms").select("id", "law_id")
    laws = table(spark, d, "laws").select(F.col("id").alias("law_id")).distinct()
    dangling = norms.where(F.col("law_id").isNotNull()).join(laws, "law_id", "left_anti").select("id")
    return norms.join(dangling, "id", "left_anti").select("id", "law_id")


def trim_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Padded keys, and whether the bare key exists too."""
    keys = table(spark, d, "law_versions").select("law_key").union(table(spark, d, "bookmarks").select("law_key")).distinct()
    bare = stripped(F.col("law_key"))
    padded = keys.where(F.col("law_key") != bare).select("law_key", bare.alias("bare"))
    there = keys.select(F.col("law_key").alias("bare"), F.lit(True).alias("conflict"))
    return padded.join(there, "bare", "left").select("law_key", "bare", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def owned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks in the folders of the user with the lowest id."""
    folders = table(spark, d, "folders").withColumn("id", uuid_key(F.col("id")))
    who = folders.agg(F.min("user_id")).scalar()
    mine = folders.where(F.col("user_id") == who).select(F.col("id").alias("folder_id")).distinct()
    return _marks(spark, d).select("id", "folder_id").distinct().join(mine, "folder_id", "left_semi").select("id", "folder_id")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks that remain when deleted folders go with theirs."""
    folders = table(spark, d, "folders").withColumn("id", uuid_key(F.col("id")))
    gone = folders.where(F.col("deleted_at").isNotNull())
    marks = _marks(spark, d).select(F.col("id").alias("mark_id"), "folder_id").distinct()
    return store.cascade(folders, marks, gone, "id", "folder_id")[1].select("mark_id", "folder_id")


def folder_patch(spark: SparkSession, d: str) -> DataFrame:
    """Folders after a patch that clears the notes of deleted ones and sets their status, and nothing else."""
    folders = store.unique(table(spark, d, "folders"), ["id"], [F.col("created_at")]).select("id", "status", "notes", "deleted_at")
    changes = folders.where(F.col("deleted_at").isNotNull()).select(
        "id", F.array(F.lit("status"), F.lit("notes")).alias("fields"), F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("notes")
    )
    return store.patch(folders.drop("deleted_at"), changes, "id", ["status", "notes"]).select("id", "status", "notes")


def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50 laws by key."""
    return store.page(current_laws(spark, d).select("law_id", "law_key", "law_title"), [F.col("law_key"), F.col("law_id")], 2)


def law_detail(spark: SparkSession, d: str) -> DataFrame:
    """Each law with its number of norms and the first ten of them by id."""
    laws = current_laws(spark, d).select("law_id", "law_key")
    norms = table(spark, d, "norms").where(F.col("law_id").isNotNull()).select("law_id", "id")
    counts = norms.groupBy("law_id").agg(F.count(F.lit(1)).alias("norms"))
    ranked = store.unique(norms, ["law_id", "id"], [F.col("id")])
    first = ranked.withColumn("n", F.row_number().over(Window.partitionBy("law_id").orderBy("id"))).where(F.col("n") <= 10)
    detail = store.nested(laws, first, "law_id", "law_id", F.col("id"), ["id"], "some")
    return detail.join(counts, "law_id", "left").select(
        "law_id", "law_key", F.coalesce("norms", F.lit(0)).alias("norms"),
        F.array_join(F.transform("some", lambda s: s["id"].cast("string")), ",").alias("first_ids"),
    )


def folder_contents(spark: SparkSession, d: str) -> DataFrame:
    """Folders that have bookmarks, with how many, and those without folder as one group."""
    folders = table(spark, d, "folders").select(uuid_key(F.col("id")).alias("folder_id")).distinct()
    marks = _marks(spark, d).select("id", "folder_id").distinct()
    counts = marks.groupBy("folder_id").agg(F.count(F.lit(1)).alias("bookmarks"))
    known = counts.join(folders, "folder_id", "left_semi")
    none = counts.where(F.col("folder_id").isNull()).select(F.lit("ungrouped").alias("folder_id"), "bookmarks")
    return known.select("folder_id", "bookmarks").unionByName(none)


def embedding_carryover(spark: SparkSession, d: str) -> DataFrame:
    """Norms without usable vector, and whether an earlier row of the same law and norm id lends one."""
    norms = table(spark, d, "norms").select("id", "law_id", stripped(F.col("norm_id")).alias("norm_id"), F.col("embedding").alias("vec"), "loaded_at")
    good = is_vector(F.col("vec"), DIM)
    keyed = norms.where(F.col("law_id").isNotNull() & F.col("norm_id").isNotNull())
    donors = store.unique(keyed.where(good), ["law_id", "norm_id"], [F.col("loaded_at").desc(), F.col("id")])
    poor = keyed.where(~good).withColumn("vec", F.lit(None).cast("array<float>"))
    return carry_over(poor, donors, ["law_id", "norm_id"], "vec").select("id", F.col("vec").isNotNull().alias("lent"))


def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Documents without later copies of the same text."""
    return drop_exact(table(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


def best_norms(spark: SparkSession, d: str) -> DataFrame:
    """Of norms with the same law and norm id the one with most lines, then most text, then the longest title."""
    n = table(spark, d, "norms").select("id", "law_id", stripped(F.col("norm_id")).alias("norm_id"), "title", "content")
    lines = F.size(F.split(F.coalesce("content", F.lit("")), "\n"))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return best_duplicate(n, ["law_id", "norm_id"], [lines, size("content"), size("title")], "id").select("id", "slot")


def disambiguated(spark: SparkSession, d: str) -> DataFrame:
    """Norm ids made distinct inside their law."""
    n = table(spark, d, "norms").select("id", "law_id", stripped(F.col("norm_id")).alias("norm_id"))
    n = n.where(F.col("law_id").isNotNull() & F.col("norm_id").isNotNull())
    return distinct_ids(n, ["law_id"], "norm_id", "id").select("id", "unique_id")


def key_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Law keys without year where that is unambiguous."""
    v = table(spark, d, "law_versions").withColumn("law_key", stripped(F.col("law_key")))
    return resolve_keys(v, "law_key", without_year(F.col("law_key")), "checked_at").select("law_key", "key")


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Laws and norms that messages cite, and whether the norm exists; unreadable lists cite nothing."""
    m = newest(table(spark, d, "messages"), ["id"], "ingested_at")
    cited = F.from_json("cited_laws", "array<struct<law_key:string,norm_id:string>>")
    rows = m.select("id", F.explode(cited).alias("c")).select("id", stripped(F.col("c.law_key")).alias("law_key"), stripped(F.col("c.norm_id")).alias("norm_id")).distinct()
    laws = current_laws(spark, d).select("law_id", "law_key")
    norms = table(spark, d, "norms").select("law_id", stripped(F.col("norm_id")).alias("norm_id"))
    known = norms.join(laws, "law_id").select("law_key", "norm_id").distinct().withColumn("known", F.lit(True))
    return rows.join(known, ["law_key", "norm_id"], "left").select("id", "law_key", "norm_id", F.coalesce("known", F.lit(False)).alias("known"))


QUERIES = {
    f.__name__: f
    for f in (
        upsert_merge, insert_missing, bookmark_sync, dedupe_first, title_backfill, orphan_delete, trim_conflicts, owned_rows,
        cascade_delete, folder_patch, paged_listing, law_detail, folder_contents, embedding_carryover, exact_dedupe, best_norms,
        disambiguated, key_resolution, citations,
    )
}

_SIDES = f"""o AS (SELECT {trim('law_key')} AS law_key, 'old' AS origin, last_changed FROM law_versions
  WHERE snap_no = (SELECT max(snap_no) FROM law_versions) AND {trim('law_key')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {trim('law_key')} ORDER BY checked_at DESC NULLS LAST, id DESC) = 1),
n AS (SELECT {trim('law_key')} AS law_key, 'new' AS origin, last_changed FROM laws WHERE {trim('law_key')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {trim('law_key')} ORDER BY loaded_at DESC NULLS LAST, id DESC) = 1)"""
_MARKS = f"""m AS (SELECT * REPLACE ({trim('law_key')} AS law_key, coalesce({trim('norm_id')}, '') AS norm_id, lower({trim('folder_id')}) AS folder_id) FROM bookmarks)"""
_FIRST = "QUALIFY row_number() OVER (PARTITION BY user_id, law_key, norm_id ORDER BY id) = 1"
_NORMS = f"n AS (SELECT id, law_id, {trim('norm_id')} AS norm_id, title, content, embedding AS vec, loaded_at FROM norms)"

SQL = {
    "upsert_merge": f"WITH {_SIDES} SELECT * FROM n UNION ALL SELECT * FROM o WHERE law_key NOT IN (SELECT law_key FROM n)",
    "insert_missing": f"WITH {_SIDES} SELECT * FROM o UNION ALL SELECT * FROM n WHERE law_key NOT IN (SELECT law_key FROM o)",
    "bookmark_sync": f"""WITH {_MARKS}, a AS (SELECT user_id, law_key, norm_id, id, synced FROM m WHERE NOT synced {_FIRST}),
b AS (SELECT user_id, law_key, norm_id, id, synced FROM m WHERE synced {_FIRST})
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id IS NOT DISTINCT FROM b.user_id
  AND a.law_key IS NOT DISTINCT FROM b.law_key AND a.norm_id = b.norm_id)""",
    "dedupe_first": f"WITH {_MARKS} SELECT id, user_id, law_key, norm_id FROM m {_FIRST}",
    "title_backfill": f"""WITH {LAWS}, {_MARKS}, t AS (SELECT law_key, law_title AS t FROM l WHERE law_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY law_key ORDER BY law_id DESC) = 1),
d AS (SELECT DISTINCT id, law_key, law_title FROM m) SELECT id, coalesce({trim('law_title')}, t, law_key) AS title FROM d LEFT JOIN t USING (law_key)""",
    "orphan_delete": "SELECT id, law_id FROM norms WHERE law_id IS NULL OR law_id IN (SELECT id FROM laws)",
    "trim_conflicts": f"""WITH k AS (SELECT law_key FROM law_versions UNION SELECT law_key FROM bookmarks)
SELECT law_key, {trim('law_key')} AS bare, {trim('law_key')} IN (SELECT law_key FROM k WHERE law_key IS NOT NULL) AS conflict FROM k WHERE law_key <> {trim('law_key')}""",
    "owned_rows": f"WITH {_MARKS} SELECT DISTINCT id, folder_id FROM m WHERE folder_id IN (SELECT lower({trim('id')}) FROM folders WHERE user_id = (SELECT min(user_id) FROM folders))",
    "cascade_delete": f"WITH {_MARKS} SELECT DISTINCT id AS mark_id, folder_id FROM m WHERE folder_id IS NULL OR folder_id NOT IN (SELECT lower({trim('id')}) FROM folders WHERE deleted_at IS NOT NULL)",
    "folder_patch": """SELECT id, CASE WHEN deleted_at IS NOT NULL THEN 'deleted' ELSE status END AS status, CASE WHEN deleted_at IS NULL THEN notes END AS notes
FROM (SELECT * FROM folders QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)""",
    "paged_listing": f"WITH {LAWS} SELECT law_id, law_key, law_title FROM l ORDER BY law_key NULLS FIRST, law_id LIMIT 50 OFFSET 50",
    "law_detail": f"""WITH {LAWS} SELECT law_id, law_key, count(n.id) AS norms, coalesce(array_to_string(list(n.id ORDER BY n.id) FILTER (n.id IS NOT NULL)[1:10], ','), '') AS first_ids
FROM l LEFT JOIN norms n USING (law_id) GROUP BY ALL""",
    "folder_contents": f"""WITH {_MARKS}, d AS (SELECT DISTINCT id, folder_id FROM m)
SELECT coalesce(folder_id, 'ungrouped') AS folder_id, count(*) AS bookmarks FROM d WHERE folder_id IS NULL OR folder_id IN (SELECT lower({trim('id')}) FROM folders) GROUP BY 1""",
    "embedding_carryover": f"""WITH {_NORMS}, g AS (SELECT *, coalesce({usable('vec')}, false) AS ok FROM n WHERE law_id IS NOT NULL AND norm_id IS NOT NULL)
SELECT id, (law_id, norm_id) IN (SELECT (law_id, norm_id) FROM g WHERE ok) AS lent FROM g WHERE NOT ok""",
    "exact_dedupe": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "best_norms": f"""WITH {_NORMS} SELECT id, min(id) OVER w AS slot FROM n WHERE law_id IS NOT NULL AND norm_id IS NOT NULL WINDOW w AS (PARTITION BY law_id, norm_id)
QUALIFY row_number() OVER (PARTITION BY law_id, norm_id ORDER BY len(string_split(coalesce(content, ''), chr(10))) DESC, length(coalesce(content, '')) DESC, length(coalesce(title, '')) DESC, id) = 1
UNION ALL SELECT id, id FROM n WHERE law_id IS NULL OR norm_id IS NULL""",
    "disambiguated": f"""WITH {_NORMS} SELECT id, norm_id || repeat('_', (row_number() OVER (PARTITION BY law_id, norm_id ORDER BY id) - 1)) AS unique_id FROM n
WHERE law_id IS NOT NULL AND norm_id IS NOT NULL""",
    "key_resolution": f"""WITH k AS (SELECT DISTINCT {trim('law_key')} AS law_key FROM law_versions), s AS (SELECT law_key, trim(regexp_replace(law_key, '\\d{{4}}$', '')) AS s FROM k WHERE law_key IS NOT NULL)
SELECT law_key, CASE WHEN count(*) OVER (PARTITION BY s) = 1 THEN s ELSE law_key END AS key FROM s""",
    "citations": f"""WITH {LAWS}, m AS (SELECT id, try_cast(cited_laws AS JSON) AS j FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
e AS (SELECT id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN j::JSON[] END) AS c FROM m),
r AS (SELECT DISTINCT id, {trim("(c->>'law_key')")} AS law_key, {trim("(c->>'norm_id')")} AS norm_id FROM e),
k AS (SELECT DISTINCT l.law_key, {trim('n.norm_id')} AS norm_id, true AS known FROM norms n JOIN l USING (law_id))
SELECT r.*, coalesce(known, false) AS known FROM r LEFT JOIN k USING (law_key, norm_id)""",
}
