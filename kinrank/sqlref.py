"""DuckDB SQL formulations of the features and signals, used only to build
the oracle queries in ``__spark_entry__``.  They restate each rule in plain
SQL, independently of the Spark expressions they check.

DuckDB differences handled here: RE2 has no look-behind (camel-case split via
a capture group), lambdas use ``lambda x: ...``, lists are 1-based.
"""

from __future__ import annotations


def lst(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


# --- fixed values, written out here so that the oracle does not share the library's lists ---
NOISE_WORDS = ("app src lib resources assets main index mod bin pkg internal common shared").split()
NOISE = lst(NOISE_WORDS)
TYPE_WORDS = lst(("controller model view service repository factory helper manager handler test spec dto dao "
                  "middleware component provider resolver presenter interactor usecase query command listener "
                  "observer").split())
GENERIC = lst("index show create edit delete update store main home base default init bootstrap".split())
RUST_WORDS = "crate super self std core alloc proc_macro".split()
JAVA_WORDS = ("com org net io gov edu java javax android kotlin sun oracle apache google").split()
CSHARP_WORDS = "system microsoft windows azure".split()
PHP_WORDS = "illuminate laravel symfony doctrine league monolog guzzle psr zend".split()
EXTERNAL = "http:// https:// // mailto: tel: javascript: data: #".split()
LANGUAGES = {"py": "python", "pyw": "python", "pyi": "python", "rs": "rust", "java": "java", "kt": "java",
             "kts": "java", "cs": "csharp", "php": "php", "phtml": "php"}
VIEW_MARKS = ("view( view()-> @extends( @include( @includeif( @includewhen( @includeunless( @includefirst( "
              "@component( @each( @livewire(").split()
# ---------------------------------------------------------------------------------------------


def tokenize(s: str) -> str:
    split = (f"string_split_regex(regexp_replace({s}, '([a-z])([A-Z])', '\\1_\\2', 'g'), "
             r"'[/\\.\-_]+')")
    return f"list_transform(list_filter({split}, lambda x: x <> ''), lambda x: lower(x))"


def fname(p: str) -> str:
    return f"regexp_extract({p}, '[^/]*$')"


def pdir(p: str) -> str:
    return f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def base_orig(p: str) -> str:
    return f"regexp_extract({fname(p)}, '^(\\.?[^.]*)', 1)"


def normalize(p: str) -> str:
    return tokenize(f"(CASE WHEN {pdir(p)} = '' THEN {base_orig(p)} "
                    f"ELSE {pdir(p)} || '/' || {base_orig(p)} END)")


def stem(p: str) -> str:
    return f"lower(split_part({fname(p)}, '.', 1))"


def basename(p: str) -> str:
    return f"lower({base_orig(p)})"


def extensions(p: str) -> str:
    return (f"list_transform(list_filter(string_split({fname(p)}, '.')[2:], lambda x: x <> ''), "
            f"lambda x: lower(x))")


def dirs(p: str) -> str:
    return f"list_filter(string_split({pdir(p)}, '/'), lambda x: x <> '')"


def _minus_types(toks: str) -> str:
    return f"list_filter({toks}, lambda x: NOT list_contains({TYPE_WORDS}, x))"


def domain(p: str) -> str:
    parent = f"regexp_extract({pdir(p)}, '[^/]*$')"
    from_parent = _minus_types(tokenize(parent))
    from_stem = _minus_types(tokenize(f"split_part({fname(p)}, '.', 1)"))
    return (f"(CASE WHEN list_contains({GENERIC}, {stem(p)}) AND len({from_parent}) > 0 "
            f"THEN {from_parent} ELSE {from_stem} END)")


def _wsum(arr: str) -> str:
    return (f"coalesce(list_sum(list_transform({arr}, lambda x: CASE WHEN list_contains({NOISE}, x) "
            f"THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END)), 0.0::DOUBLE)")


def wjaccard(a: str, b: str) -> str:
    u = _wsum(f"list_distinct(list_concat({a}, {b}))")
    i = _wsum(f"list_intersect({a}, {b})")
    return (f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE "
            f"WHEN {u} = 0 THEN 0.0::DOUBLE ELSE {i} / {u} END)")


def one_sided(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE "
            f"WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {wjaccard(a, b)} END)")


def set_jaccard(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {u} = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / {u} END)"


def dir_prox(da: str, db: str) -> str:
    n = f"greatest(len({da}), len({db}))"
    eq = f"list_transform(range(1, {n} + 1), lambda i: coalesce({da}[i] = {db}[i], false))"
    common = f"coalesce(list_position({eq}, false) - 1, {n})"
    return f"(CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE {common} / {n} END)"


def lev_sim(a: str, b: str) -> str:
    n = f"greatest(strlen({a}), strlen({b}))"
    return f"(CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE 1.0 - levenshtein({a}, {b}) / {n} END)"


def name_sim(t: str, c: str, boost: float) -> str:
    return (f"(CASE WHEN {t} = '' OR {c} = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, "
            f"jaro_winkler_similarity({t}, {c}) + CASE WHEN contains({c}, {t}) OR contains({t}, {c}) "
            f"THEN {boost}::DOUBLE ELSE 0.0::DOUBLE END) END)")


def specificity(freq: str, total: str) -> str:
    idf = f"ln(1 + {total} / ({freq} - 1.0)) / ln(1 + {total})"
    return (f"(CASE WHEN {total} <= 1 THEN 1.0::DOUBLE WHEN {freq} <= 2 THEN 1.0::DOUBLE "
            f"ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow({idf}, 2))) END)")


# ------------------------------------------------------------ references
def trim_ws(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def _tok_flat(parts: str) -> str:
    return f"flatten(list_transform({parts}, lambda g: {tokenize('g')}))"


def _nonempty_split(s: str, sep_regex: str) -> str:
    return f"list_filter(string_split_regex({s}, '{sep_regex}'), lambda g: g <> '')"


def _drop(toks: str, stop=()) -> str:
    cond = "strlen(y) >= 2" + (f" AND NOT list_contains({lst(stop)}, y)" if stop else "")
    return f"list_filter({toks}, lambda y: {cond})"


def uri_tokens(v: str) -> str:
    s = trim_ws(v)
    ext = " OR ".join(f"starts_with({s}, '{p}')" for p in EXTERNAL)
    path = f"regexp_extract(regexp_extract({s}, '^([^?]*)', 1), '^([^#]*)', 1)"
    seg_tokens = tokenize("split_part(g, '.', 1)")
    slash = _drop(f"flatten(list_transform(list_filter(string_split({path}, '/'), lambda g: g <> ''), "
                  f"lambda g: {seg_tokens}))", NOISE_WORDS)
    nophp = f"regexp_replace(regexp_replace({s}, '(\\.php)+$', ''), '(\\.PHP)+$', '')"
    back = _drop(_tok_flat(f"list_filter(string_split({nophp}, chr(92)), lambda g: g <> '')"), NOISE_WORDS)
    dot_ok = (f"(contains({s}, '.') AND NOT contains({s}, ' ') AND NOT contains({s}, '/') "
              f"AND NOT contains({s}, chr(92)) AND list_bool_and(list_transform(string_split({s}, '.'), "
              f"lambda g: strlen(g) >= 2 AND regexp_full_match(g, '[\\p{{L}}\\p{{N}}_]+') "
              f"AND NOT regexp_full_match(g, '[0-9]+'))))")
    dots = _drop(_tok_flat(f"list_filter(string_split({s}, '.'), lambda g: g <> '')"))
    toks = (f"(CASE WHEN {s} = '' OR {ext} THEN NULL WHEN contains({s}, '/') THEN {slash} "
            f"WHEN contains({s}, chr(92)) THEN {back} WHEN {dot_ok} THEN {dots} END)")
    return f"(CASE WHEN len({toks}) >= 2 THEN {toks} END)"


def module_tokens(p: str, extra=()) -> str:
    return _drop(_tok_flat(_nonempty_split(p, "[.:\\\\]")), (*NOISE_WORDS, *extra))


def quoted(line: str) -> str:
    found = f"regexp_extract_all({line}, '\"[^\"\\n]*\"|''[^''\\n]*''|[\"''][^\\n]*')"
    return (f"list_transform(list_filter({found}, lambda q: length(q) >= 2 AND right(q, 1) = left(q, 1)), "
            f"lambda q: substring(q, 2, length(q) - 2))")


def language(path: str) -> str:
    name = fname(path)
    ext = f"(CASE WHEN regexp_full_match({name}, '\\.?[^.]*') THEN '' ELSE regexp_extract({name}, '[^.]*$') END)"
    cases = " ".join(f"WHEN {ext} = '{e}' THEN '{lang}'" for e, lang in LANGUAGES.items())
    return f"(CASE {cases} ELSE 'generic' END)"


def python_refs(line: str) -> str:
    rest = trim_ws(f"regexp_replace(substr({line}, 6), '^[.]+', '')")
    w = f"string_split_regex({rest}, '\\s+')"
    from_form = (f"(CASE WHEN {w}[1] = 'import' AND {w}[2] IS NOT NULL THEN regexp_replace({w}[2], ',+$', '') "
                 f"WHEN {w}[2] = 'import' AND {w}[1] <> 'import' THEN {w}[1] END)")
    imp = trim_ws(f"split_part(split_part(substr({line}, 8), ',', 1), ' as ', 1)")
    m = (f"(CASE WHEN starts_with({line}, '#') THEN NULL WHEN starts_with({line}, 'from ') THEN {from_form} "
         f"WHEN starts_with({line}, 'import ') THEN {imp} END)")
    t = module_tokens(m)
    return f"(CASE WHEN {m} <> '' AND len({t}) > 0 THEN [{t}] ELSE [] END)"


def rust_refs(line: str) -> str:
    rest = f"substr({line}, 5)"
    path = trim_ws(f"regexp_replace(split_part(regexp_replace({rest}, ';+$', ''), '{{', 1), '(::)+$', '')")
    segs = f"list_filter(string_split({path}, '::'), lambda g: g <> '')"
    module = f"array_to_string({segs}[1:len({segs}) - 1], '::')"
    mod_t = module_tokens(module, RUST_WORDS)
    full_t = module_tokens(path, RUST_WORDS)
    use_refs = (f"list_filter([CASE WHEN len({segs}) >= 2 AND len({mod_t}) > 0 THEN {mod_t} END, "
                f"CASE WHEN len({full_t}) > 0 THEN {full_t} END], lambda r: r IS NOT NULL)")
    name = trim_ws(f"regexp_replace(substr({line}, 5), ';+$', '')")
    mt = _drop(tokenize(name))
    mod_refs = f"(CASE WHEN NOT contains({name}, '{{') AND len({mt}) > 0 THEN [{mt}] ELSE [] END)"
    return (f"(CASE WHEN starts_with({line}, '//') THEN [] WHEN starts_with({line}, 'use ') THEN {use_refs} "
            f"WHEN starts_with({line}, 'mod ') THEN {mod_refs} ELSE [] END)")


def java_refs(line: str) -> str:
    rest = f"regexp_replace(substr({line}, 8), '^static ', '')"
    path = trim_ws(f"regexp_replace(regexp_replace({rest}, ';+$', ''), '(\\.\\*)+$', '')")
    t = module_tokens(path, JAVA_WORDS)
    return (f"(CASE WHEN NOT starts_with({line}, '//') AND NOT starts_with({line}, '*') "
            f"AND starts_with({line}, 'import ') AND len({t}) >= 2 THEN [{t}] ELSE [] END)")


def csharp_refs(line: str) -> str:
    rest = f"regexp_replace(substr({line}, 7), '^static ', '')"
    after = f"(CASE WHEN contains({rest}, ' = ') THEN substr({rest}, strpos({rest}, ' = ') + 3) ELSE {rest} END)"
    path = trim_ws(f"regexp_replace({after}, ';+$', '')")
    t = module_tokens(path, CSHARP_WORDS)
    return (f"(CASE WHEN NOT starts_with({line}, '//') AND NOT starts_with({line}, '*') "
            f"AND starts_with({line}, 'using ') AND len({t}) >= 2 THEN [{t}] ELSE [] END)")


# ------------------------------------------------------------------- PHP
def php_live(line: str) -> str:
    return " AND ".join(f"NOT starts_with({line}, '{m}')" for m in ("//", "*", "#"))


def dedup_adjacent(toks: str) -> str:
    return f"list_transform(list_filter(list_zip({toks}, {toks}[2:]), lambda z: z[1] IS NOT NULL AND z[1] IS DISTINCT FROM z[2]), lambda z: z[1])"


def php_use(line: str) -> str:
    path = trim_ws(f"regexp_replace(split_part(substr({line}, 5), ' as ', 1), ';+$', '')")
    toks = _drop(_tok_flat(f"list_filter(string_split({path}, chr(92)), lambda g: g <> '')"), (*NOISE_WORDS, *PHP_WORDS))
    return (f"(CASE WHEN starts_with({line}, 'use ') AND NOT starts_with({path}, '(') AND len({toks}) > 0 "
            f"THEN [{toks}] ELSE [] END)")


def php_class(line: str) -> str:
    names = f"regexp_extract_all({line}, '([A-Za-z0-9_\\\\]+)::class', 1)"
    return f"list_filter(list_transform({names}, lambda n: {module_tokens('n', PHP_WORDS)}), lambda t: len(t) > 0)"


def php_component(line: str) -> str:
    names = f"regexp_extract_all({line}, '<x-([A-Za-z0-9\\-.:/]+)', 1)"
    parts = _drop(_tok_flat("list_filter(string_split_regex(n, '[.:/-]'), lambda g: g <> '')"))
    return f"list_transform({names}, lambda n: list_concat(['components'], {parts}))"


def php_hinted(line: str, marks) -> str:
    return "(" + " OR ".join(f"contains(lower({line}), '{m}')" for m in marks) + ")"


def php_quoted(line: str, context: str) -> str:
    found = f"list_filter(list_transform({quoted(line)}, lambda v: {uri_tokens('v')}), lambda t: t IS NOT NULL)"
    joined = f"list_concat(['{context}'], t)"
    return f"list_transform({found}, lambda t: {dedup_adjacent(joined)})"
