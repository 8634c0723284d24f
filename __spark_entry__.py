"""

Every query reads the given tables (or tables Spark derives from them) in
full.  Doubles are rounded to 9 places on both sides so that summation order
does not decide equality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinrank import sqlref as Q
from kinrank.functions import similarity as S
from kinrank.operators import cochange as co
from kinrank.operators import content as CT
from kinrank.operators import overlap as OV
from kinrank.operators import pairs as PR
from kinrank.operators import php as PHP
from kinrank.operators import refs as RF
from kinrank.operators import stats as ST
from kinrank.plans import relatedness as RL
from kinrank.plans.features import item_features
from kinrank.session import shared_dir
from kinrank.sources import loaders as LD
from kinrank.sources import tables as T

SMOKE_DIR = "/root/testdata/sf0.001"
DIGITS = 9


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), DIGITS).alias(f.name)
                       if isinstance(f.dataType, DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


# ---------------------------------------------------------------- co-change
def q_cochange_pairs(spark, d):
    return _rounded(co.cochange_pairs(T.changes(spark, d)))


def q_cochange_score(spark, d):
    return _rounded(co.cochange_scores(co.cochange_pairs(T.changes(spark, d))))


def q_cochange_topk(spark, d):
    return _rounded(co.cochange_topk(T.changes(spark, d), n=10))


def q_change_type_filter(spark, d):
    return co.filter_change_types(T.changes(spark, d))


def q_recent_groups(spark, d):
    return co.recent_groups(co.filter_change_types(T.changes(spark, d, with_time=True)), 400)


def q_cochange_recent(spark, d):
    ch = co.limit_history(co.filter_change_types(T.changes(spark, d, with_time=True)), 400)
    return _rounded(co.cochange_scores(co.cochange_pairs(ch)))


# ----------------------------------------------------------- item features
def _feats(spark, d):
    return item_features(T.item_paths(spark, d))


def q_path_tokens(spark, d):
    return _feats(spark, d).select("item_id", "path", "path_tokens")


def q_names(spark, d):
    return _feats(spark, d).select("item_id", "stem", "basename", "extensions", "language")


def q_domain_tokens(spark, d):
    return _feats(spark, d).select("item_id", "domain")


def q_basename_freq(spark, d):
    f = _feats(spark, d)
    return ST.basename_freq(f).crossJoin(F.broadcast(ST.corpus_size(f)))


def q_specificity(spark, d):
    return _rounded(ST.with_specificity(_feats(spark, d)).select("item_id", "basename", "specificity"))


def q_recency(spark, d):
    it = T.item_paths(spark, d).join(T.item_mtimes(spark, d), "item_id", "left")
    return _rounded(it.crossJoin(F.broadcast(T.as_of_time(spark, d)))
                    .select("item_id", S.recency(F.col("mtime"), F.col("as_of")).alias("recency")))


# ------------------------------------------------ pair signals (co-changed pairs)
def _pair_rows(spark, d, unordered=False):
    pairs = co.cochange_pairs(T.changes(spark, d)).select("target", "candidate")
    if unordered:                                   # every pair comes in both orders
        pairs = pairs.where(F.col("target") < F.col("candidate"))
    return PR.attach_sides(pairs, _feats(spark, d))


def q_token_jaccard(spark, d):
    return _rounded(PR.both_ways(PR.cheap_signals(_pair_rows(spark, d, unordered=True)), "jaccard_similarity"))


def q_domain_sim(spark, d):
    return _rounded(PR.cheap_signals(_pair_rows(spark, d)).select("target", "candidate", "domain_similarity"))


def q_extension_sim(spark, d):
    return _rounded(PR.cheap_signals(_pair_rows(spark, d))
                    .select("target", "candidate", "extension_similarity"))


def q_name_sim(spark, d):
    return _rounded(PR.name_similarities(_pair_rows(spark, d))
                    .select("target", "candidate", "stem_similarity", "filename_similarity"))


def q_lev_sim(spark, d):
    return _rounded(PR.both_ways(PR.path_levenshtein(_pair_rows(spark, d, unordered=True)), "lev_similarity"))


def q_path_jw(spark, d):
    return _rounded(PR.path_jaro_winkler(_pair_rows(spark, d)).select("target", "candidate", "path_jw"))


def q_dir_proximity(spark, d):
    return _rounded(PR.cheap_signals(_pair_rows(spark, d))
                    .select("target", "candidate", "dir_proximity", "same_directory", "exact_name_match"))


# ------------------------------------------------------------ relatedness
TARGET_HOURS = 48          # targets: items changed within this time before the newest change
HISTORY = 400              # change groups that count


def _history(spark, d):
    return co.limit_history(co.filter_change_types(T.changes(spark, d, with_time=True)), HISTORY)


def _recent_targets(spark, d, hours=TARGET_HOURS):
    newest = T.as_of_time(spark, d).first()["as_of"]
    ch = co.filter_change_types(T.changes(spark, d, with_time=True))
    return (ch.where(F.col("ts") >= F.lit(newest) - F.expr(f"INTERVAL {hours} HOURS"))
            .select(F.col("item").alias("item_id")).distinct())


def _relatedness(spark, d, targets, **kw):
    return RL.relatedness(T.items(spark, d), targets, changes=_history(spark, d),
                          as_of=T.as_of_time(spark, d), **kw)


def q_relatedness(spark, d):
    return _rounded(_relatedness(spark, d, _recent_targets(spark, d)))


def q_relatedness_topk(spark, d):
    return _rounded(_relatedness(spark, d, _recent_targets(spark, d), top_n=10))


def q_explain(spark, d):
    return _rounded(_relatedness(spark, d, _recent_targets(spark, d), top_n=10, explain=True)
                    .select("target", "candidate", "rank", "labels"))


def q_relatedness_all_topk(spark, d):
    """Every item as a target (exact; quadratic in the corpus).  Not
    registered: checked against ``ALL_TARGETS_SQL`` on the smallest data set
    in tests/test_entry.py."""
    return _rounded(_relatedness(spark, d, T.item_paths(spark, d).select("item_id"), top_n=10))


# ---------------------------------------------------------------- content
def q_content_tokens(spark, d):
    toks = CT.document_tokens(T.read_table(spark, d, "documents"))
    return toks.select(F.col("id").alias("doc_id"), F.size("tokens").alias("n_tokens"),
                       F.array_sort("tokens").alias("tokens"))


def _content_join(spark, d, t):
    sets = CT.document_tokens(T.read_table(spark, d, "documents"))
    pairs, _ = CT.similarity_join(sets, t)
    return _rounded(pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "intersection", "jaccard"))


def q_content_classes(spark, d):
    """Documents with equal word sets: the smallest doc_id names the class."""
    return CT.set_classes(CT.document_tokens(T.read_table(spark, d, "documents"))).select(
        F.col("id").alias("doc_id"), F.col("rep").alias("class_id"))


def q_content_jaccard(spark, d):
    """Pairs of classes (by their smallest doc_id); `content_classes` has the members."""
    return _content_join(spark, d, 0.5)


def q_content_neardup(spark, d):
    """As content_jaccard, at 0.8."""
    return _content_join(spark, d, 0.8)


# ------------------------------------------------------------- references
def _code_lines(spark, d):
    return RF.content_lines(T.code_items(spark, d))


def _page_lines(spark, d):
    pages = T.read_table(spark, d, "pages").select(
        F.col("page_id").alias("item_id"), F.lit("page.html").alias("path"), F.col("html").alias("content"))
    return RF.content_lines(pages)


def q_quoted_refs(spark, d):
    code = RF.generic_ref_edges(_code_lines(spark, d)).withColumn("source", F.lit("code"))
    pages = RF.generic_ref_edges(_page_lines(spark, d)).withColumn("source", F.lit("page"))
    return code.unionByName(pages)


def q_import_refs(spark, d):
    return RF.language_ref_edges(_code_lines(spark, d))


def q_php_refs(spark, d):
    return PHP.php_ref_edges(T.code_items(spark, d))


def q_php_use_class_component(spark, d):
    return PHP.php_name_edges(_code_lines(spark, d))


def q_php_view_route(spark, d):
    return PHP.php_hinted_edges(_code_lines(spark, d))


def q_php_values(spark, d):
    return PHP.php_value_edges(T.code_items(spark, d))


def q_ref_overlap(spark, d):
    """The best reference bonus of every (target, candidate) pair; its rows grow with the pairs."""
    return _rounded(OV.ref_overlap(RF.ref_edges(T.code_items(spark, d)), _feats(spark, d)))


def q_ref_target_classes(spark, d):
    uses, _ = OV.memberships(RF.ref_edges(T.code_items(spark, d)), _feats(spark, d))
    return OV.target_classes(uses).select(F.col("target").alias("item_id"), "target_class")


def q_ref_uses(spark, d):
    uses, _ = OV.memberships(RF.ref_edges(T.code_items(spark, d)), _feats(spark, d))
    return uses.select("target", F.split("ref", OV.MARK).alias("tokens"), "weight")


def q_path_set_classes(spark, d):
    _, sets = OV.memberships(RF.ref_edges(T.code_items(spark, d)), _feats(spark, d))
    return sets.select(F.col("candidate").alias("item_id"), F.col("kind").alias("candidate_class"))


q_ref_overlap_pairs = q_ref_overlap


# ------------------------------------------------------------- exclusions
# An ignore list: generated declaration files and one vendor folder.
EXCLUDE_PATTERNS = (r"\.d\.ts$", r"^src/promo/")


def q_exclusions_anti(spark, d):
    return LD.exclude(T.item_paths(spark, d), EXCLUDE_PATTERNS)


def q_exclusions_table(spark, d):
    """The rules come from a table."""
    return LD.exclude_by(T.item_paths(spark, d), T.rules(spark, d))


def q_files_scan(spark, d):
    """The items written as a tree of files, hidden folders and names included, and scanned again."""
    root = shared_dir(spark)
    T.write_tree(spark, d, root)
    return LD.read_files(spark, root).select("path", "content")


def q_relativized_paths(spark, d):
    """Paths below a project root or behind './', as an ingest sees them."""
    given = F.expr("concat(CASE item_id % 3 WHEN 0 THEN '/data/project/' WHEN 1 THEN './' ELSE '././' END, path)")
    return LD.relativize(T.item_paths(spark, d).withColumn("path", given), "/data/project")


def q_ranked_written(spark, d):
    """The co-change ranking persisted and read back."""
    path = shared_dir(spark)
    LD.write_ranked(co.cochange_topk(T.changes(spark, d), n=10), path)
    return _rounded(spark.read.parquet(path))


def q_cochange_uncapped(spark, d):
    """Co-change without a size cap, over one group for each day (hundreds of items)."""
    days = T.changes(spark, d, with_time=True)
    days = days.select(F.datediff("ts", F.lit("1998-01-01")).cast("long").alias("group_id"), "item")
    return _rounded(co.cochange_topk(days, n=3, max_size=None))


def q_changelog_parse(spark, d):
    """A change log written from the orders (newest first), parsed again."""
    path = shared_dir(spark)
    T.write_changelog(spark, d, path)
    return LD.parse_changelog(spark, path).select("group_id", "line_no", "item")


_CH = f"""ch AS (SELECT DISTINCT l_orderkey AS group_id, l_partkey AS item FROM lineitem),
 g AS (SELECT group_id, count(*) AS n FROM ch GROUP BY group_id HAVING count(*) BETWEEN 2 AND 64),
 m AS (SELECT ch.group_id, ch.item, g.n FROM ch JOIN g USING (group_id)),
 p AS (SELECT a.item AS target, b.item AS candidate, sum(1 / sqrt(a.n)) AS weighted_count,
              count(*) AS commit_count
       FROM m a JOIN m b ON a.group_id = b.group_id AND a.item <> b.item GROUP BY 1, 2),
 s AS (SELECT p.*, p.weighted_count / max(p.weighted_count) OVER (PARTITION BY target) AS score FROM p)"""

_RECENT = """ch0 AS (SELECT l.l_orderkey AS group_id, l.l_partkey AS item, o.o_orderdate AS ts,
                   CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'A' ELSE 'M' END AS change_type
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
 ch1 AS (SELECT * FROM ch0 WHERE change_type IN ('A', 'C', 'M', 'R')),
 rg AS (SELECT group_id, max(ts) AS ts FROM ch1 GROUP BY group_id
        ORDER BY ts DESC, group_id DESC LIMIT 400)"""

_IT = f"it AS (SELECT p_partkey AS item_id, {T.PART_PATH_SQL} AS path FROM part)"
_F = (f"f AS (SELECT item_id, path, {Q.normalize('path')} AS path_tokens, {Q.stem('path')} AS stem, "
      f"{Q.basename('path')} AS basename, {Q.extensions('path')} AS extensions, "
      f"{Q.domain('path')} AS domain, {Q.pdir('path')} AS dir, {Q.dirs('path')} AS dirs FROM it)")
_FS = "fs AS (SELECT *, array_to_string(path_tokens, ' ') AS path_string FROM f)"
_FREQ = ("fq AS (SELECT basename, count(*) AS freq FROM f WHERE basename <> '' GROUP BY basename), "
         "tot AS (SELECT count(*) AS total_files FROM f)")
_MT = ("mt AS (SELECT l_partkey AS item_id, max(o_orderdate) AS mtime FROM lineitem "
       "JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), "
       "ao AS (SELECT max(o_orderdate) AS as_of FROM orders)")
_SIDES = ", ".join(f"t.{c} AS t_{c}, c.{c} AS c_{c}" for c in
                   ("path", "path_tokens", "path_string", "stem", "basename", "extensions",
                    "domain", "dir", "dirs"))
_PR = (f"pr AS (SELECT p.target, p.candidate, {_SIDES} FROM p "
       f"JOIN fs t ON t.item_id = p.target JOIN fs c ON c.item_id = p.candidate)")
_PAIRS = f"WITH {_CH}, {_IT}, {_F}, {_FS}, {_PR}"


def _r(e, name):
    return f"round({e}, {DIGITS}) AS {name}"



_CI = f"ci AS (SELECT p_partkey AS item_id, {T.CODE_PATH_SQL} AS path, {T.CODE_CONTENT_SQL} AS content FROM part)"


def _lines(src: str, name: str) -> str:
    line = Q.trim_ws("regexp_replace(raw, '\\r$', '')")
    return (f"{name} AS (SELECT item_id, path, {line} AS line FROM (SELECT item_id, path, "
            f"unnest(string_split(coalesce(content, ''), chr(10))) AS raw FROM {src}))")


_PG = "pg AS (SELECT page_id AS item_id, 'page.html' AS path, html AS content FROM pages)"
_QR = (f"qr AS (SELECT * FROM (SELECT item_id, 'quoted' AS kind, {Q.uri_tokens('q')} AS tokens, "
       f"1.0::DOUBLE AS weight FROM (SELECT item_id, unnest({Q.quoted('line')}) AS q FROM ln)) "
       f"WHERE tokens IS NOT NULL)")
_IR = (f"ir AS (SELECT item_id, lang AS kind, unnest(refs) AS tokens, 1.0::DOUBLE AS weight FROM ("
       f"SELECT item_id, lang, CASE lang WHEN 'python' THEN {Q.python_refs('line')} "
       f"WHEN 'rust' THEN {Q.rust_refs('line')} WHEN 'java' THEN {Q.java_refs('line')} "
       f"ELSE {Q.csharp_refs('line')} END AS refs FROM (SELECT *, {Q.language('path')} AS lang FROM ln) "
       f"WHERE lang IN ('python', 'rust', 'java', 'csharp')))")
_PHP_NAMES = f"""SELECT item_id, 'php_use' AS kind, unnest({Q.php_use('line')}) AS tokens, 1.05::DOUBLE AS weight FROM pln
      UNION ALL SELECT item_id, 'php_class', unnest({Q.php_class('line')}), 1.25 FROM pln
      UNION ALL SELECT item_id, 'php_component', unnest({Q.php_component('line')}), 1.35 FROM pln"""
_PHP_HINTED = f"""SELECT item_id, 'php_view' AS kind, unnest({Q.php_quoted('line', 'views')}) AS tokens, 1.40::DOUBLE AS weight
      FROM pln WHERE {Q.php_hinted('line', Q.VIEW_MARKS)}
      UNION ALL SELECT item_id, 'php_route', unnest({Q.php_quoted('line', 'routes')}), 1.15
      FROM pln WHERE {Q.php_hinted('line', ['route('])}
      UNION ALL SELECT item_id, 'php_route_file', ['routes', 'web'], 1.10 FROM pln WHERE {Q.php_hinted('line', ['route('])}"""
_PHP_LINES = f"""pln AS (SELECT item_id, line, rn FROM (SELECT item_id, path, line, rn FROM lno) WHERE {Q.language('path')} = 'php'
      AND {Q.php_live('line')})"""


def _numbered(src: str) -> str:
    line = Q.trim_ws("regexp_replace(raw, '\\r$', '')")
    return (f"lno AS (SELECT item_id, path, {line} AS line, rn FROM (SELECT item_id, path, "
            f"unnest(string_split(coalesce(content, ''), chr(10))) AS raw, "
            f"unnest(range(len(string_split(coalesce(content, ''), chr(10))))) AS rn FROM {src}))")


# Assignments of a literal, of a variable, and of a literal before a variable; then calls with a
# variable (first in its argument), a literal before a variable, and a literal, wrapped or not.
_ENV = r"""r0 AS (SELECT item_id, rn, m[1] AS v, m[2] AS value FROM (SELECT *, regexp_extract_all(line, '^\$(\w+) = ''([^'']*)'';$', 1) || regexp_extract_all(line, '^\$(\w+) = ''([^'']*)'';$', 2) AS m FROM pln) WHERE len(m) = 2),
      a1 AS (SELECT item_id, rn, regexp_extract(line, '^\$(\w+) = ', 1) AS v, regexp_extract(line, '^\$\w+ = \$(\w+);$', 1) AS src FROM pln),
      r1 AS (SELECT a.item_id, a.rn, a.v, r.value FROM (SELECT * FROM a1 WHERE src <> '') a
             ASOF JOIN r0 r ON a.item_id = r.item_id AND a.src = r.v AND a.rn >= r.rn),
      r01 AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1),
      a2 AS (SELECT item_id, rn, regexp_extract(line, '^\$(\w+) = ', 1) AS v, regexp_extract(line, '^\$\w+ = ''([^'']*)'' \. \$\w+;$', 1) AS lit,
                    regexp_extract(line, '^\$\w+ = ''[^'']*'' \. \$(\w+);$', 1) AS src FROM pln),
      r2 AS (SELECT a.item_id, a.rn, a.v, a.lit || r.value AS value FROM (SELECT * FROM a2 WHERE src <> '') a
             ASOF JOIN r01 r ON a.item_id = r.item_id AND a.src = r.v AND a.rn >= r.rn),
      env AS (SELECT * FROM r01 UNION ALL SELECT * FROM r2),
      u AS (SELECT item_id, rn, regexp_extract(line, 'view\(\$(\w+)', 1) AS v, '' AS lit FROM pln
            UNION ALL SELECT item_id, rn, regexp_extract(line, 'view\(''[^'']*'' \. \$(\w+)\)', 1),
                             regexp_extract(line, 'view\(''([^'']*)'' \. ', 1) FROM pln),
      vals AS (SELECT u.item_id, 'php_view' AS kind, 'views' AS ctx, 1.40::DOUBLE AS weight, u.lit || e.value AS value
               FROM (SELECT * FROM u WHERE v <> '') u ASOF JOIN env e ON u.item_id = e.item_id AND u.v = e.v AND u.rn >= e.rn
               UNION ALL SELECT item_id, 'php_view', 'views', 1.40, value FROM (SELECT item_id,
                 regexp_extract(line, 'view\(\(*''([^'']*)''\)*\)', 1) AS value FROM pln) WHERE value <> ''
               UNION ALL SELECT item_id, 'php_route', 'routes', 1.15, value FROM (SELECT item_id,
                 regexp_extract(line, 'to_route\(''([^'']*)''\)', 1) AS value, unnest([1, 2]) AS needle FROM pln) WHERE value <> '')"""
_PHP_VALUES = f"""SELECT item_id, kind, {Q.dedup_adjacent(f"list_concat([ctx], {Q.uri_tokens('value')})")} AS tokens, weight FROM vals"""


def _all_refs(src: str) -> str:
    """rf: the distinct references of the items of `src`, all languages."""
    return f"""{_lines(src, 'ln')}, {_numbered(src)}, {_PHP_LINES}, {_ENV}, {_QR}, {_IR},
      rf AS (SELECT DISTINCT item_id AS target, tokens, weight FROM (SELECT * FROM qr UNION ALL SELECT * FROM ir
             UNION ALL {_PHP_NAMES} UNION ALL {_PHP_HINTED} UNION ALL {_PHP_VALUES}) WHERE len(tokens) > 0)"""


def _relatedness_sql(targets_sql: str, top_n: int | None = None, labels: bool = False) -> str:
    spec = Q.specificity("coalesce(freq, 1)", "total_files")
    rec = ("CASE WHEN mtime IS NULL OR mtime > as_of THEN 0.0 "
           "ELSE exp(-((epoch_us(as_of) - epoch_us(mtime)) / 3.6e9) / 69.3) END")
    ctok = (r"list_distinct(list_transform(list_filter(string_split_regex(coalesce(content, ''), "
            r"'[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2), lambda x: lower(x)))")
    cols = ("path_tokens", "path_string", "stem", "basename", "extensions", "domain", "dir", "dirs",
            "specificity", "recency", "ctoks")
    sides = ", ".join(f"t.{c} AS t_{c}, c.{c} AS c_{c}" for c in cols)
    sv = "t_specificity"
    cv = "c_specificity"
    base = (f"domain_similarity * 0.26 * (0.25 + {sv} * 0.75) + jaccard_similarity * 0.18 "
            f"+ dir_proximity * 0.15 + path_jw * 0.03 + lev_similarity * 0.02 "
            f"+ (stem_similarity * 0.22 + filename_similarity * 0.12 + extension_similarity * 0.02) "
            f"* (0.15 + {sv} * 0.85) * (0.35 + {cv} * 0.65) "
            f"+ CASE WHEN exact_name_match THEN {sv} * {cv} * 0.60 ELSE 0.0 END "
            f"+ CASE WHEN same_directory THEN (1.0 - {sv}) * 0.30 ELSE 0.0 END")
    out_cols = ["target", "candidate", _r("total", "total"), _r("domain_similarity", "domain_similarity"),
                _r("stem_similarity", "stem_similarity"), _r("filename_similarity", "filename_similarity"),
                _r("jaccard_similarity", "jaccard_similarity"), _r("dir_proximity", "dir_proximity"),
                "same_directory", "exact_name_match", _r("t_specificity", "target_specificity"),
                _r("feature_bonus", "feature_bonus"), _r("cochange_bonus", "cochange_bonus"),
                "cochange_commits", _r("recency_bonus", "recency_bonus"),
                _r("content_bonus", "content_bonus")]
    sql = f"""WITH {_RECENT}, ch AS (SELECT DISTINCT group_id, item FROM ch1 WHERE group_id IN (SELECT group_id FROM rg)),
      {_CH.split('),', 1)[1]}, {_IT}, {_F}, {_FS}, {_FREQ}, {_MT}, tg AS ({targets_sql}),
      pc AS (SELECT p_partkey AS item_id, {T.PART_PATH_SQL} AS path, {T.PART_CONTENT_SQL} AS content FROM part),
      tc AS (SELECT pc.* FROM pc JOIN tg USING (item_id)), {_all_refs('tc')},
      fb AS (SELECT target, candidate, max(least(share * weight, 1.5)) AS bonus FROM (
               SELECT rf.target, c.item_id AS candidate, rf.weight,
                      len(list_filter(rf.tokens, lambda x: list_contains(c.path_tokens, x))) / len(rf.tokens) AS share
               FROM rf CROSS JOIN f c WHERE rf.target <> c.item_id) WHERE share >= 0.5 GROUP BY 1, 2),
      fx AS (SELECT fs.*, CASE WHEN fs.basename = '' THEN 1.0 ELSE {spec} END AS specificity,
                    {rec} AS recency, {ctok} AS ctoks
             FROM fs LEFT JOIN fq USING (basename) CROSS JOIN tot LEFT JOIN mt USING (item_id)
             CROSS JOIN ao LEFT JOIN (SELECT item_id, content FROM pc) dd USING (item_id)),
      pr AS (SELECT t.item_id AS target, c.item_id AS candidate, {sides}
             FROM fx t JOIN tg ON t.item_id = tg.item_id CROSS JOIN fx c WHERE t.item_id <> c.item_id),
      sg AS (SELECT pr.*,
               {Q.one_sided('t_domain', 'c_domain')} AS domain_similarity,
               {Q.one_sided('t_extensions', 'c_extensions')} AS extension_similarity,
               {Q.wjaccard('t_path_tokens', 'c_path_tokens')} AS jaccard_similarity,
               {Q.dir_prox('t_dirs', 'c_dirs')} AS dir_proximity,
               t_dir = c_dir AS same_directory, t_basename = c_basename AS exact_name_match,
               {Q.lev_sim('t_path_string', 'c_path_string')} AS lev_similarity,
               jaro_winkler_similarity(t_path_string, c_path_string) AS path_jw,
               {Q.name_sim('t_stem', 'c_stem', 0.15)} AS stem_similarity,
               {Q.name_sim('t_basename', 'c_basename', 0.10)} AS filename_similarity,
               coalesce(s.score, 0.0) * 0.25 AS cochange_bonus,
               coalesce(s.commit_count, 0) AS cochange_commits,
               coalesce(fb.bonus, 0.0) * 0.3 AS feature_bonus, c_recency * 0.1 AS recency_bonus
             FROM pr LEFT JOIN s USING (target, candidate) LEFT JOIN fb USING (target, candidate)),
      b AS (SELECT *, {base} AS base FROM sg),
      tt AS (SELECT *, CASE WHEN base >= 0.9 THEN {Q.set_jaccard('t_ctoks', 'c_ctoks')} * 0.1
                            ELSE 0.0 END AS content_bonus FROM b),
      res AS (SELECT *, base + recency_bonus + content_bonus + feature_bonus + cochange_bonus AS total
              FROM tt WHERE base + recency_bonus + content_bonus + feature_bonus + cochange_bonus >= 0.3)"""
    if top_n is None:
        return sql + f" SELECT {', '.join(out_cols)} FROM res"
    ranked = (f" SELECT * FROM (SELECT {', '.join(out_cols)}, row_number() OVER (PARTITION BY target "
              f"ORDER BY round(total, 9) DESC, candidate) AS rank FROM res) WHERE rank <= {top_n}")
    if not labels:
        return sql + ranked
    f2 = lambda c: f"printf('%.2f', {c})"
    parts = [f"CASE WHEN feature_bonus >= 0.20 THEN 'direct-ref +' || {f2('feature_bonus')} END",
             f"CASE WHEN cochange_bonus >= 0.08 THEN 'co-change +' || {f2('cochange_bonus')} || ' (' "
             f"|| cochange_commits || ' commits)' END",
             "CASE WHEN same_directory AND target_specificity < 0.8 THEN 'same-dir' END",
             "CASE WHEN exact_name_match AND target_specificity >= 0.8 THEN 'exact-name' END",
             f"CASE WHEN stem_similarity >= 0.95 AND NOT exact_name_match THEN 'stem ' || "
             f"{f2('stem_similarity')} END",
             f"CASE WHEN domain_similarity >= 0.85 THEN 'domain ' || {f2('domain_similarity')} END",
             f"CASE WHEN filename_similarity >= 0.9 THEN 'filename ' || {f2('filename_similarity')} END",
             f"CASE WHEN content_bonus >= 0.05 THEN 'content +' || {f2('content_bonus')} END",
             f"CASE WHEN recency_bonus >= 0.05 THEN 'recent +' || {f2('recency_bonus')} END"]
    found = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    fallback = f"['path ' || {f2('jaccard_similarity')} || ', dir ' || {f2('dir_proximity')}]"
    return (sql + f""" SELECT target, candidate, rank,
        CASE WHEN len({found}) > 0 THEN {found} ELSE {fallback} END AS labels
        FROM (SELECT res.*, t_specificity AS target_specificity, row_number() OVER (PARTITION BY target
              ORDER BY round(total, 9) DESC, candidate) AS rank FROM res) WHERE rank <= {top_n}""")


ALL_TARGETS_SQL = _relatedness_sql("SELECT p_partkey AS item_id FROM part", top_n=10)

_TARGETS = f"""SELECT DISTINCT l_partkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag <> 'R' AND o_orderdate >= (SELECT max(o_orderdate) FROM orders)
              - INTERVAL {TARGET_HOURS} HOUR"""

_DT = (r"dt AS (SELECT doc_id, list_distinct(list_transform(list_filter(string_split_regex("
       r"coalesce(text, ''), '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2), lambda x: lower(x))) AS toks "
       r"FROM documents)")


_CLS = "cl AS (SELECT min(doc_id) AS doc_id, list_sort(toks) AS toks FROM dt GROUP BY list_sort(toks))"


def _content_sql(t: float) -> str:
    return f"""WITH {_DT}, {_CLS},
      pr AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, len(a.toks) AS na, len(b.toks) AS nb,
                    len(list_intersect(a.toks, b.toks)) AS intersection
             FROM cl a JOIN cl b ON a.doc_id < b.doc_id
             WHERE len(a.toks) > 0 AND len(b.toks) > 0
               AND len(b.toks) >= len(a.toks) * {t} AND len(a.toks) >= len(b.toks) * {t})
      SELECT doc_a, doc_b, intersection, round(intersection / (na + nb - intersection), {DIGITS}) AS jaccard
      FROM pr WHERE intersection / (na + nb - intersection) >= {t}"""

_REF_CLASSES = f"""WITH {_CI}, {_all_refs('ci')}, {_IT}, {_F},
        cs AS (SELECT item_id, list_sort(list_distinct(path_tokens)) AS cset FROM f)"""

# Targets with equal references and weights.
_TARGET_CLASSES = """us AS (SELECT target, tokens, max(weight) AS weight FROM rf GROUP BY target, tokens),
        tl AS (SELECT target, list_sort(list({'t': tokens, 'w': weight})) AS refs FROM us GROUP BY target),
        tn AS (SELECT refs, min(target) AS target_class, count(*) AS u FROM tl GROUP BY refs)"""

REF_PAIRS_SQL = f"""WITH {_CI}, {_all_refs('ci')}, {_IT}, {_F},
        sc AS (SELECT rf.target, c.item_id AS candidate, rf.weight,
                      len(list_filter(rf.tokens, lambda x: list_contains(c.path_tokens, x))) / len(rf.tokens) AS share
               FROM rf CROSS JOIN f c WHERE rf.target <> c.item_id)
        SELECT target, candidate, round(max(least(share * weight, 1.5)), {DIGITS}) AS bonus
        FROM sc WHERE share >= 0.5 GROUP BY target, candidate"""

ORACLE = {
    "cochange_pairs": f"""WITH {_CH}
        SELECT target, candidate, round(weighted_count, {DIGITS}) AS weighted_count, commit_count FROM p""",
    "cochange_score": f"""WITH {_CH}
        SELECT target, candidate, round(weighted_count, {DIGITS}) AS weighted_count, commit_count,
               round(score, {DIGITS}) AS score FROM s""",
    "cochange_topk": f"""WITH {_CH}
        SELECT * FROM (SELECT target, candidate, round(weighted_count, {DIGITS}) AS weighted_count,
               commit_count, round(score, {DIGITS}) AS score,
               row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, candidate) AS rank FROM s)
        WHERE rank <= 10""",
    "change_type_filter": """SELECT l_orderkey AS group_id, l_partkey AS item, change_type FROM (
        SELECT *, CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'A' ELSE 'M' END AS change_type
        FROM lineitem) WHERE change_type IN ('A', 'C', 'M', 'R')""",
    "recent_groups": f"WITH {_RECENT} SELECT group_id, ts FROM rg",
    "cochange_recent": f"""WITH {_RECENT},
        ch AS (SELECT DISTINCT group_id, item FROM ch1 WHERE group_id IN (SELECT group_id FROM rg)),
        {_CH.split('),', 1)[1]}
        SELECT target, candidate, round(weighted_count, {DIGITS}) AS weighted_count, commit_count,
               round(score, {DIGITS}) AS score FROM s""",
    "path_tokens": f"WITH {_IT}, {_F} SELECT item_id, path, path_tokens FROM f",
    "names": f"""WITH {_IT}, {_F} SELECT item_id, stem, basename, extensions,
        {Q.language('path')} AS language FROM f""",
    "domain_tokens": f"WITH {_IT}, {_F} SELECT item_id, domain FROM f",
    "basename_freq": f"WITH {_IT}, {_F}, {_FREQ} SELECT basename, freq, total_files FROM fq, tot",
    "specificity": f"""WITH {_IT}, {_F}, {_FREQ} SELECT item_id, f.basename,
        {_r(f"CASE WHEN f.basename = '' THEN 1.0 ELSE {Q.specificity('coalesce(freq, 1)', 'total_files')} END",
            'specificity')} FROM f LEFT JOIN fq USING (basename), tot""",
    "recency": f"""WITH {_IT}, {_MT} SELECT item_id, {_r(
        "CASE WHEN mtime IS NULL OR mtime > as_of THEN 0.0 "
        "ELSE exp(-((epoch_us(as_of) - epoch_us(mtime)) / 3.6e9) / 69.3) END", 'recency')}
        FROM it LEFT JOIN mt USING (item_id), ao""",
    "token_jaccard": f"""{_PAIRS} SELECT target, candidate,
        {_r(Q.wjaccard('t_path_tokens', 'c_path_tokens'), 'jaccard_similarity')} FROM pr""",
    "domain_sim": f"""{_PAIRS} SELECT target, candidate,
        {_r(Q.one_sided('t_domain', 'c_domain'), 'domain_similarity')} FROM pr""",
    "extension_sim": f"""{_PAIRS} SELECT target, candidate,
        {_r(Q.one_sided('t_extensions', 'c_extensions'), 'extension_similarity')} FROM pr""",
    "name_sim": f"""{_PAIRS} SELECT target, candidate,
        {_r(Q.name_sim('t_stem', 'c_stem', 0.15), 'stem_similarity')},
        {_r(Q.name_sim('t_basename', 'c_basename', 0.10), 'filename_similarity')} FROM pr""",
    "lev_sim": f"""{_PAIRS} SELECT target, candidate,
        {_r(Q.lev_sim('t_path_string', 'c_path_string'), 'lev_similarity')} FROM pr""",
    "path_jw": f"""{_PAIRS} SELECT target, candidate,
        {_r('jaro_winkler_similarity(t_path_string, c_path_string)', 'path_jw')} FROM pr""",
    "dir_proximity": f"""{_PAIRS} SELECT target, candidate,
        {_r(Q.dir_prox('t_dirs', 'c_dirs'), 'dir_proximity')},
        t_dir = c_dir AS same_directory, t_basename = c_basename AS exact_name_match FROM pr""",
    "content_tokens": f"""WITH {_DT} SELECT doc_id, len(toks) AS n_tokens, list_sort(toks) AS tokens
        FROM dt""",
    "content_classes": f"""WITH {_DT} SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(toks)) AS class_id FROM dt""",
    "content_jaccard": _content_sql(0.5),
    "content_neardup": _content_sql(0.8),
    "quoted_refs": f"""WITH {_CI}, {_lines('ci', 'ln')}, {_QR},
        {_PG}, {_lines('pg', 'pl')}, {_QR.replace('qr AS', 'qp AS').replace('FROM ln', 'FROM pl')}
        SELECT *, 'code' AS source FROM qr UNION ALL SELECT *, 'page' AS source FROM qp""",
    "import_refs": f"WITH {_CI}, {_lines('ci', 'ln')}, {_IR} SELECT * FROM ir",
    "ref_overlap": REF_PAIRS_SQL,
    "ref_target_classes": f"""{_REF_CLASSES}, {_TARGET_CLASSES}
        SELECT target AS item_id, target_class FROM tl JOIN tn ON tl.refs = tn.refs""",
    "ref_uses": f"""{_REF_CLASSES} SELECT target, tokens, max(weight) AS weight FROM rf GROUP BY target, tokens""",
    "path_set_classes": f"""WITH {_IT}, {_F},
        cs AS (SELECT item_id, list_sort(list_distinct(path_tokens)) AS cset FROM f)
        SELECT item_id, min(item_id) OVER (PARTITION BY cset) AS candidate_class FROM cs""",
    "php_use_class_component": f"WITH {_CI}, {_numbered('ci')}, {_PHP_LINES} {_PHP_NAMES}",
    "php_view_route": f"WITH {_CI}, {_numbered('ci')}, {_PHP_LINES} {_PHP_HINTED}",
    "php_values": f"WITH {_CI}, {_numbered('ci')}, {_PHP_LINES}, {_ENV} {_PHP_VALUES}",
    "php_refs": f"""WITH {_CI}, {_numbered('ci')}, {_PHP_LINES}, {_ENV}
        {_PHP_NAMES} UNION ALL {_PHP_HINTED} UNION ALL {_PHP_VALUES}""",
    "changelog_parse": f"""WITH l AS (SELECT o_orderdate, o_orderkey, l_linenumber AS n, l_partkey AS k, {T.PART_PATH_SQL} AS item
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
        w AS (SELECT * FROM l UNION ALL SELECT DISTINCT o_orderdate, o_orderkey, -1, -1, NULL FROM l),
        o AS (SELECT *, dense_rank() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS group_id,
                     row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC, n, k) AS line_no FROM w)
        SELECT group_id::BIGINT AS group_id, line_no::BIGINT AS line_no, item FROM o WHERE item IS NOT NULL""",
    "exclusions_anti": f"""WITH {_IT} SELECT item_id, path FROM it
        WHERE NOT regexp_matches(path, '\\.d\\.ts$') AND NOT regexp_matches(path, '^src/promo/')""",
    "exclusions_table": f"""WITH {_IT}, ru AS ({T.RULES_SQL})
        SELECT item_id, path FROM it WHERE NOT EXISTS (SELECT 1 FROM ru WHERE regexp_matches(path, pattern))""",
    "files_scan": f"""SELECT {T.TREE_PATH_SQL} AS path,
        concat({T.PART_CONTENT_SQL}, CASE WHEN p_partkey % 50 = 1 THEN chr(65533) ELSE '' END) AS content FROM part""",
    "relativized_paths": f"WITH {_IT} SELECT item_id, path FROM it",
    "relatedness": _relatedness_sql(_TARGETS),
    "relatedness_topk": _relatedness_sql(_TARGETS, top_n=10),
    "explain": _relatedness_sql(_TARGETS, top_n=10, labels=True),
}

ORACLE["ranked_written"] = ORACLE["cochange_topk"]
ORACLE["cochange_uncapped"] = f"""WITH {_CH.replace("SELECT DISTINCT l_orderkey AS group_id, l_partkey AS item FROM lineitem",
        "SELECT DISTINCT datediff('day', DATE '1998-01-01', o_orderdate::DATE)::BIGINT AS group_id, l_partkey AS item "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
        .replace("BETWEEN 2 AND 64", ">= 2")}
        SELECT * FROM (SELECT target, candidate, round(weighted_count, {DIGITS}) AS weighted_count,
               commit_count, round(score, {DIGITS}) AS score,
               row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, candidate) AS rank FROM s)
        WHERE rank <= 3"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cochange_pairs": q_cochange_pairs,
    "cochange_score": q_cochange_score,
    "cochange_topk": q_cochange_topk,
    "change_type_filter": q_change_type_filter,
    "recent_groups": q_recent_groups,
    "cochange_recent": q_cochange_recent,
    "path_tokens": q_path_tokens,
    "names": q_names,
    "domain_tokens": q_domain_tokens,
    "basename_freq": q_basename_freq,
    "specificity": q_specificity,
    "recency": q_recency,
    "token_jaccard": q_token_jaccard,
    "domain_sim": q_domain_sim,
    "extension_sim": q_extension_sim,
    "name_sim": q_name_sim,
    "lev_sim": q_lev_sim,
    "path_jw": q_path_jw,
    "dir_proximity": q_dir_proximity,
    "content_tokens": q_content_tokens,
    "content_classes": q_content_classes,
    "content_jaccard": q_content_jaccard,
    "content_neardup": q_content_neardup,
    "quoted_refs": q_quoted_refs,
    "import_refs": q_import_refs,
    "php_refs": q_php_refs,
    "php_use_class_component": q_php_use_class_component,
    "php_view_route": q_php_view_route,
    "php_values": q_php_values,
    "ref_overlap": q_ref_overlap,
    "ref_target_classes": q_ref_target_classes,
    "ref_uses": q_ref_uses,
    "path_set_classes": q_path_set_classes,
    "exclusions_anti": q_exclusions_anti,
    "exclusions_table": q_exclusions_table,
    "files_scan": q_files_scan,
    "relativized_paths": q_relativized_paths,
    "ranked_written": q_ranked_written,
    "cochange_uncapped": q_cochange_uncapped,
    "changelog_parse": q_changelog_parse,
    "relatedness": q_relatedness,
    "relatedness_topk": q_relatedness_topk,
    "explain": q_explain,
}


# Training-data operators: present only if their subpackage is.
try:
    from kinrank.llm.queries import ORACLE as _LLM_ORACLE
    from kinrank.llm.queries import QUERIES as _LLM_QUERIES
except ImportError:
    _LLM_QUERIES, _LLM_ORACLE = {}, {}
QUERIES.update(_LLM_QUERIES)
ORACLE.update(_LLM_ORACLE)
try:
    import corpus_pipeline
except ImportError:
    pass
else:
    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: each part's 10 most co-purchased parts (co-change top-k)."""
    return q_cochange_topk(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
