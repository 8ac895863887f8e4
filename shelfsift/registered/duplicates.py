"""Duplicate, survivorship and copy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import has_hash, not_blank
from ..operators import duplicates as D
from ..operators import survivorship as S
from ..operators.categories import effective_category
from ..testtables import files, table
from .common import AUTO, BYTES_TEXT, CAT, EFF, EXACT_GROUPS, IDENTITY, TITLE_GROUPS, register

SELECTED = "ord % 97 = 3"
HEIGHT = (
    "coalesce(list_max(list_filter(list_transform(regexp_extract_all(file_name, '[0-9]+'), lambda t: CAST(t AS BIGINT)), "
    "lambda h: h IN (2160, 1440, 1080, 720, 576, 480, 360, 240))), 0)"
)
QUALITY = f"(CASE WHEN quality > 0 THEN quality ELSE {HEIGHT} END)"
LENGTH = "(CASE WHEN duration_seconds > 0 THEN CAST(round_even(duration_seconds, 0) AS BIGINT) ELSE 0 END)"
RANK = f"CASE WHEN integrity = 'Corrupt' THEN 1 ELSE 0 END, {QUALITY} DESC, {LENGTH} DESC, size_bytes, upper(full_path), ord, id"


@register("exact_duplicates", f"WITH {EXACT_GROUPS} SELECT * FROM exact_groups")
def _(spark, sf):
    return D.exact_duplicates(files(spark, sf))


@register("exact_duplicate_members", f"WITH {EXACT_GROUPS} SELECT hash_key, id, full_path, size_bytes FROM files JOIN exact_groups ON upper(sha256) = hash_key")
def _(spark, sf):
    return D.exact_duplicate_members(files(spark, sf))


@register(
    "exact_duplicates_text",
    """SELECT hash_key, count(*) AS copies, arg_min(size_bytes, (full_path, id)) * (count(*) - 1) AS reclaimable, min(full_path) AS first_path
       FROM (SELECT CAST(doc_id AS VARCHAR) AS id, upper(sha256(text)) AS hash_key, n_chars AS size_bytes,
                    concat('/docs/', source, '/', CAST(doc_id AS VARCHAR)) AS full_path FROM documents) t
       GROUP BY hash_key HAVING count(*) > 1""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size_bytes"),
        F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("full_path"),
    )
    return D.exact_duplicates(docs)


@register(
    "title_duplicates",
    f"""WITH {TITLE_GROUPS}
    SELECT title_group, members, contents, total_bytes, reclaimable, differs_in_size,
           CASE WHEN head.n <> '' THEN concat(head.t, ' — ', head.n) WHEN head.y IS NOT NULL THEN concat(head.t, ' (', head.y, ')')
                ELSE head.t END AS display FROM title_groups""",
)
def _(spark, sf):
    return D.title_duplicates(files(spark, sf), effective_category())


@register(
    "title_duplicate_members",
    f"WITH {TITLE_GROUPS} SELECT title_group, id, full_path, size_bytes FROM keyed WHERE title_group IN (SELECT title_group FROM title_groups)",
)
def _(spark, sf):
    return D.title_duplicate_members(files(spark, sf), effective_category())


@register(
    "title_duplicate_group_for",
    f"""WITH {TITLE_GROUPS} SELECT title_group, id, full_path, size_bytes FROM keyed
    WHERE title_group IN (SELECT title_group FROM title_groups)
      AND title_group IN (SELECT title_group FROM keyed WHERE {SELECTED})""",
)
def _(spark, sf):
    rows = files(spark, sf)
    return D.title_duplicate_group_for(rows, rows.filter(SELECTED), effective_category())


@register(
    "copies_of",
    f"""SELECT id, full_path FROM files WHERE sha256 <> '' AND NOT ({SELECTED})
        AND upper(sha256) IN (SELECT upper(sha256) FROM files WHERE {SELECTED} AND sha256 <> '')""",
)
def _(spark, sf):
    rows = files(spark, sf)
    return D.copies_of(rows, rows.filter(SELECTED)).select("id", "full_path")


NEAR_STAND_IN = "duration_seconds > 2470"


@register(
    "duplicate_flags",
    f"""WITH {EXACT_GROUPS}, {TITLE_GROUPS}
    SELECT id, full_path, CASE WHEN sha256 <> '' AND upper(sha256) IN (SELECT hash_key FROM exact_groups) THEN 'DUP'
      WHEN {NEAR_STAND_IN} THEN '~dup' WHEN title_group IN (SELECT title_group FROM title_groups) THEN 'title' ELSE '' END AS duplicate_flag
    FROM keyed""",
)
def _(spark, sf):
    rows = files(spark, sf)
    return D.duplicate_flags(rows, rows.filter(NEAR_STAND_IN).select("id"), effective_category())


@register(
    "catalog_summary",
    f"""WITH {EXACT_GROUPS}, {TITLE_GROUPS}, totals AS (
      SELECT count(*) AS files, count(*) FILTER (kind = 'Video') AS video, count(*) FILTER (kind = 'Audio') AS audio,
             count(*) FILTER (sha256 = '') AS unhashed FROM files),
    sets AS (SELECT count(*) AS duplicate_sets, CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS reclaimable FROM exact_groups),
    near AS (SELECT count(DISTINCT label) AS near_sets FROM embeddings)
    SELECT *, (SELECT count(*) FROM title_groups) AS title_sets, {BYTES_TEXT.format(x='reclaimable')} AS reclaimable_text FROM totals, sets, near""",
)
def _(spark, sf):
    near = table(spark, sf, "embeddings").select("label").distinct()
    return D.catalog_summary(files(spark, sf), near, effective_category())


@register(
    "rank_candidates",
    f"""SELECT title_group, id, row_number() OVER (PARTITION BY title_group ORDER BY {RANK}) AS rank
        FROM (SELECT *, {IDENTITY} AS title_group FROM files) WHERE title_group IS NOT NULL""",
)
def _(spark, sf):
    rows = files(spark, sf).withColumn("title_group", D.claimed_identity(effective_category())).filter("title_group IS NOT NULL")
    return S.rank_candidates(rows, ["title_group"]).select("title_group", "id", "rank")


@register(
    "best_by_name_quality",
    f"""SELECT title_group, id, full_path FROM (SELECT *, row_number() OVER (PARTITION BY title_group
          ORDER BY {HEIGHT} DESC, size_bytes DESC, ord, id) AS rn FROM (SELECT *, {IDENTITY} AS title_group FROM files) WHERE title_group IS NOT NULL)
        WHERE rn = 1""",
)
def _(spark, sf):
    rows = files(spark, sf).withColumn("title_group", D.claimed_identity(effective_category())).filter("title_group IS NOT NULL")
    return S.best_by_name_quality(rows, ["title_group"]).select("title_group", "id", "full_path")


@register(
    "duplicates_of_consolidated",
    """SELECT f.id, f.full_path, upper(f.sha256) AS hash_key, k.keeper.id AS keeper_id FROM files f JOIN (
         SELECT upper(sha256) AS h, min({'p': full_path, 'id': id}) FILTER (consolidated) AS keeper FROM files WHERE sha256 <> ''
         GROUP BY 1 HAVING count(*) > 1 AND bool_or(consolidated)) k ON upper(f.sha256) = k.h WHERE f.id <> k.keeper.id""",
)
def _(spark, sf):
    return S.duplicates_of_consolidated(files(spark, sf))


@register(
    "redundant_copies",
    """SELECT id, full_path, upper(sha256) AS hash_key FROM files WHERE sha256 <> '' AND NOT consolidated
         AND upper(sha256) IN (SELECT upper(sha256) FROM files WHERE consolidated AND sha256 <> '')""",
)
def _(spark, sf):
    return S.redundant_copies(files(spark, sf))


@register(
    "prefer_library_copy",
    """SELECT hash_key, id, library_rank FROM (SELECT *, row_number() OVER (PARTITION BY hash_key ORDER BY library_rank, ord, id) AS rn FROM (
         SELECT *, upper(sha256) AS hash_key, CASE WHEN consolidated THEN 0 WHEN full_path LIKE '/lib/films/%' THEN 1 ELSE 2 END AS library_rank
         FROM files WHERE sha256 <> '')) WHERE rn = 1""",
)
def _(spark, sf):
    rows = files(spark, sf).filter(has_hash()).withColumn("hash_key", F.upper("sha256")).withColumn(
        "library_rank", S.library_preference(F.col("consolidated"), F.col("full_path").startswith("/lib/films/"), F.lit("/lib/tv"))
    )
    return S.prefer_library_copy(rows, ["hash_key"], columns=["id", "library_rank"])


def _fold_oracle(verdict: str, columns: str, key: str = IDENTITY) -> str:
    """Recursive fold: one row per key and position, carrying the standing winner."""
    return f"""WITH copies AS (SELECT title_group, {{'id': id, {columns}}} AS item,
        row_number() OVER (PARTITION BY title_group ORDER BY ord, id) AS n, count(*) OVER (PARTITION BY title_group) AS copies
      FROM (SELECT *, {key} AS title_group FROM files) WHERE title_group IS NOT NULL),
    folded AS (
      SELECT title_group, n, copies, item AS best, false AS undecided FROM copies WHERE n = 1
      UNION ALL
      SELECT title_group, n, copies, CASE WHEN v = 2 AND NOT undecided THEN f2 ELSE f1 END, undecided OR v NOT IN (1, 2) FROM (
        SELECT p.title_group, c.n, p.copies, p.undecided, p.best AS f1, c.item AS f2, CASE {verdict} ELSE 0 END AS v
        FROM (SELECT title_group, n, copies, undecided, best AS f1, best FROM folded) p
        JOIN (SELECT title_group, n, item AS f2, item FROM copies) c ON p.title_group = c.title_group AND c.n = p.n + 1))
    SELECT title_group, copies, CASE WHEN NOT undecided THEN best.id END AS winner_id, undecided FROM folded WHERE n = copies"""


STEPS = (S.RuleStep("Integrity"), S.RuleStep("Quality", tolerance=400), S.RuleStep("Length", tolerance=10), S.RuleStep("Size", "lesser"))


@register(
    "choose_by_rules",
    _fold_oracle(
        "WHEN f1.i <> f2.i THEN CASE WHEN f1.i > f2.i THEN 1 ELSE 2 END "
        "WHEN abs(f1.q - f2.q) > 400 THEN CASE WHEN f1.q > f2.q THEN 1 ELSE 2 END "
        "WHEN abs(f1.l - f2.l) > 10 THEN CASE WHEN f1.l > f2.l THEN 1 ELSE 2 END "
        "WHEN f1.s <> f2.s THEN CASE WHEN f1.s > f2.s THEN 2 ELSE 1 END",
        "'i': CASE integrity WHEN 'Ok' THEN 2 WHEN 'NotChecked' THEN 1 ELSE 0 END, 'q': nullif(quality, 0), "
        "'l': CASE WHEN duration_seconds > 0 THEN duration_seconds END, 's': size_bytes",
    ),
)
def _(spark, sf):
    rows = files(spark, sf).withColumn("title_group", D.claimed_identity(effective_category())).filter("title_group IS NOT NULL")
    return S.choose_by_rules(rows, ["title_group"], STEPS)


PAIR_RULES = S.default_pair_rules(60)


@register(
    "choose_by_pair_rules",
    _fold_oracle(
        "WHEN f1.content_key <> f2.content_key THEN 0 WHEN f1.length > 0 AND f2.length > 0 AND abs(f1.length - f2.length) > 60 THEN 0 "
        "WHEN f1.quality > f2.quality AND f1.sound THEN 1 WHEN f2.quality > f1.quality AND f2.sound THEN 2 "
        "WHEN f1.length > f2.length AND f1.sound THEN 1 WHEN f2.length > f1.length AND f2.sound THEN 2 "
        "WHEN f1.size <= f2.size AND f1.sound THEN 1 WHEN f2.sound THEN 2",
        "'content_key': CASE WHEN extension = '.AVI' AND size_bytes % 7 = 0 THEN 1 ELSE 0 END, 'length': duration_seconds, 'quality': quality, "
        "'size': size_bytes, 'sound': integrity <> 'Corrupt'",
    ),
)
def _(spark, sf):
    rows = files(spark, sf).withColumn("title_group", D.claimed_identity(effective_category())).filter("title_group IS NOT NULL")
    measures = {"length": "length double, sound boolean", "fingerprint": "content_key int"}
    needed = S.needs_measure(spark, PAIR_RULES, "id string, quality int, size bigint", measures)
    rows = rows.withColumns({"size": F.col("size_bytes")})
    columns = ["quality", "size"]
    # Only the measure tables the rules mention are joined.
    if "length" in needed:
        lengths = files(spark, sf).select("id", F.col("duration_seconds").alias("length"), (F.col("integrity") != "Corrupt").alias("sound"))
        rows, columns = rows.join(lengths, "id"), [*columns, "length", "sound"]
    if "fingerprint" in needed:
        content = F.when((F.col("extension") == ".AVI") & (F.col("size_bytes") % 7 == 0), 1).otherwise(0)
        rows, columns = rows.join(files(spark, sf).select("id", content.alias("content_key")), "id"), [*columns, "content_key"]
    return S.choose_by_pair_rules(rows, ["title_group"], PAIR_RULES, columns)


@register(
    "choose_by_builtin_steps",
    _fold_oracle(
        "WHEN f1.i <> f2.i THEN CASE WHEN f1.i > f2.i THEN 1 ELSE 2 END WHEN f1.q <> f2.q THEN CASE WHEN f1.q > f2.q THEN 1 ELSE 2 END "
        "WHEN abs(f1.l - f2.l) > 0.5 THEN CASE WHEN f1.l > f2.l THEN 1 ELSE 2 END WHEN f1.s <> f2.s THEN CASE WHEN f1.s > f2.s THEN 2 ELSE 1 END",
        "'i': CASE integrity WHEN 'Ok' THEN 2 WHEN 'NotChecked' THEN 1 ELSE 0 END, 'q': nullif(quality, 0), 'l': CASE WHEN duration_seconds > 0 THEN duration_seconds END, 's': size_bytes",
    ),
)
def _(spark, sf):
    rows = files(spark, sf).withColumn("title_group", D.claimed_identity(effective_category())).filter("title_group IS NOT NULL")
    return S.choose_by_rules(rows, ["title_group"], S.BUILT_IN_STEPS)


EXPLAINED = (S.RuleStep("Integrity"), S.RuleStep("Quality", tolerance=400), S.RuleStep("Length", tolerance=10), S.RuleStep("NameLength", "lesser"), S.RuleStep("AlreadyFiled"))


@register(
    "explain_rule",
    f"""WITH v AS (SELECT {IDENTITY} AS title_group, id, ord, CASE integrity WHEN 'Ok' THEN 2 WHEN 'NotChecked' THEN 1 ELSE 0 END AS i, nullif(quality, 0) AS q,
        CASE WHEN duration_seconds > 0 THEN duration_seconds END AS l, length(file_name) AS n, consolidated::INT AS c FROM files),
    h AS (SELECT title_group, arg_min(v, (ord, id)) AS a FROM v WHERE title_group IS NOT NULL GROUP BY 1),
    p AS (SELECT h.a, v AS b FROM v JOIN h USING (title_group) WHERE v.id <> h.a.id),
    t AS (SELECT a.id AS a_id, b.id AS b_id, a, b, ['corrupt', 'not checked', 'sound'] AS words, ['not filed', 'in the library'] AS filed FROM p)
    SELECT a_id, b_id, CASE WHEN a.i <> b.i THEN concat('max Integrity — ', words[a.i + 1], ' against ', words[b.i + 1])
      WHEN abs(a.q - b.q) > 400 THEN concat('max Quality ± 400 — ', a.q, ' against ', b.q)
      WHEN abs(a.l - b.l) > 10 THEN concat('max Length ± 10 — ', {{len_a}}, ' against ', {{len_b}})
      WHEN a.n <> b.n THEN concat('min Length of the name — ', a.n, ' against ', b.n)
      WHEN a.c <> b.c THEN concat('max Already in the library — ', filed[a.c + 1], ' against ', filed[b.c + 1]) ELSE 'all_equal' END AS why FROM t""".replace(
        "{len_a}", "printf('%d:%02d:%02d', CAST(floor(a.l / 3600) AS BIGINT), CAST(floor(a.l % 3600 / 60) AS BIGINT), CAST(floor(a.l % 60) AS BIGINT))").replace(
        "{len_b}", "printf('%d:%02d:%02d', CAST(floor(b.l / 3600) AS BIGINT), CAST(floor(b.l % 3600 / 60) AS BIGINT), CAST(floor(b.l % 60) AS BIGINT))"),
)
def _(spark, sf):
    """The first copy of each claimed identity against every other one."""
    values = F.struct("id", *[S.rule_value(step).alias(f"v{i}") for i, step in enumerate(EXPLAINED)])
    rows = files(spark, sf).withColumn("title_group", D.claimed_identity(effective_category())).filter("title_group IS NOT NULL")
    rows = rows.select("title_group", "ord", "id", values.alias("b"))
    firsts = rows.groupBy("title_group").agg(F.min_by("b", F.struct("ord", "id")).alias("a"))
    pairs = rows.join(firsts, "title_group").filter(F.col("a.id") != F.col("b.id"))
    return S.explain_pairs(pairs, EXPLAINED).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "why")


# Plugin fields of the test catalogue: numbers, texts that are none, truths in several spellings, dates, and absences.
_PLUGIN = {
    "pages": "CASE ord % 5 WHEN 0 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN concat(' ', CAST(ord % 90 AS STRING), '.5 ') ELSE CAST(ord % 700 AS STRING) END",
    "owned": "CASE ord % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN '' END",
    "bought": "CASE ord % 4 WHEN 0 THEN concat(CAST(2000 + ord % 25 AS STRING), '-03-0', CAST(ord % 9 + 1 AS STRING)) WHEN 1 THEN 'last week' WHEN 2 THEN '' END",
    "note": "CASE ord % 3 WHEN 0 THEN parsed_title WHEN 1 THEN '' END",
}


@register(
    "typed_plugin_value",
    f"""WITH p AS (SELECT id, {_PLUGIN['pages']} AS pages, {_PLUGIN['owned']} AS owned, {_PLUGIN['bought']} AS bought, {_PLUGIN['note']} AS note FROM files),
    v AS (SELECT id, TRY_CAST(trim(pages) AS DOUBLE) AS n, CASE WHEN lower(trim(owned)) IN ('true', 'yes', '1') THEN 1.0 WHEN owned <> '' THEN 0.0 END::DOUBLE AS t,
      (epoch(TRY_CAST(bought AS DATE)) - 946684800)::DOUBLE AS d, nullif(note, '') AS x FROM p)
    SELECT id, n AS number_step, coalesce(n, 0) AS number_filter, t AS truth_step, coalesce(t, 0) AS truth_filter, d AS date_step, coalesce(d, 0) AS date_filter, x AS text_step, coalesce(x, '') AS text_filter FROM v""",
)
def _(spark, sf):
    fields = F.create_map(*[part for name, text in _PLUGIN.items() for part in (F.lit(name), F.expr(text))])
    rows = files(spark, sf).withColumn("plugin_fields", fields)
    kinds = (("number", "Pages"), ("truth", "owned"), ("date", "bought"), ("text", "note"))
    columns = [S.typed_plugin_value(name, kind, step).alias(f"{kind}_{'step' if step else 'filter'}") for kind, name in kinds for step in (True, False)]
    return rows.select("id", *columns)
