"""Queries over the virtual symbol corpus, each with the DuckDB SQL that it should agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symquarry.extract.table import extract_symbols
from symquarry.functions import names, paths
from symquarry.operators import diff
from symquarry.plans import parser, render, search, stats
from symquarry.plans.sample_sources import SAMPLES
from symquarry.schema import KIND_RANKING
from symquarry.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- the corpus and its functions in DuckDB SQL ---


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _norm(x: str) -> str:
    for pattern in (r"([\p{Ll}])([\p{Lu}])", r"([\p{Lu}])([\p{Lu}][\p{Ll}])", r"(\p{L})([0-9])", r"([0-9])(\p{L})"):
        x = rf"regexp_replace({x}, '{pattern}', '\1_\2', 'g')"
    singular = (
        "case when octet_length(encode(t)) < 4 or ends_with(t, 'ss') then t when ends_with(t, 'ies') then left(t, length(t) - 3) || 'y' "
        "when ends_with(t, 'ie') then left(t, length(t) - 2) || 'y' when ends_with(t, 's') then left(t, length(t) - 1) else t end"
    )
    return rf"array_to_string(list_transform(list_filter(string_split_regex(lower({x}), '[_\-./: \t]'), lambda t: t <> ''), lambda t: {singular}), '_')"


def _prefix(column: str, word: str) -> str:
    return f"(starts_with({column}, '{word}') or contains({column}, '_{word}'))"


def _scan(column: str, word: str, whole: bool) -> str:
    s = f"string_split({column}, '{word}')"
    after = f" and (starts_with({s}[i + 1], '_') or (i + 1 = len({s}) and {s}[i + 1] = ''))" if whole else ""
    return f"(len(list_filter(range(1, len({s})), lambda i: ((i = 1 and {s}[i] = '') or ends_with({s}[i], '_')){after})) > 0)"


CORPUS_SQL = f"""
repos as (select n_nationkey::bigint as id, n_name as name, '/r/' || n_name as root,
  case when n_nationkey % 7 = 0 then null else 'c' || n_nationkey end as head, n_nationkey % 5 = 0 as dirty from nation),
files0 as (select doc_id as id, doc_id % 25 as repo_id, n_chars as size,
  case when doc_id < 25 then 'README.md' else source || '/' || lang || '/' || ({_list(corpus.NOUNS)})[doc_id % 8 + 1] || 'Guide' || doc_id || '.md' end as path from documents),
files as (select *, {_norm('path')} as path_norm from files0),
code0 as (select p_partkey + 1000000 as id, p_partkey % 200 as file_id, p_size::int as line, ({_list(corpus.CODE_KINDS)})[p_partkey % 12 + 1] as kind,
  case when p_partkey % 4 = 0 then null else p_type end as scope, ({_list(corpus.NOUNS)})[p_partkey % 8 + 1] as noun, string_split(p_name, ' ')[1] as adj, p_name, p_partkey % 5 as form from part),
code1 as (select id, file_id, line, kind, scope, case form when 0 then noun when 1 then noun || '_' || adj when 2 then noun || 'ry'
  when 3 then upper(adj[1]) || adj[2:] || upper(noun[1]) || noun[2:] || 's' else p_name end as name from code0),
code as (select *, {_norm('name')} as name_norm, {_norm("concat_ws('::', scope, name)")} as qual_norm from code1),
symbols as (select id, repo_id, id as file_id, null::int as line, 'file' as kind, path as name, null::varchar as scope, path_norm as name_norm, path_norm as qual_norm, path, path_norm from files
  union all select c.id, f.repo_id, c.file_id, c.line, c.kind, c.name, c.scope, c.name_norm, c.qual_norm, f.path, f.path_norm from code c join files f on f.id = c.file_id)"""

_RANK_SQL = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KIND_RANKING)) + " else 99 end"
_SHOWN = "id, repo, path, line, kind, scope, name, name_norm, qual_norm"
_ORDER = "specific desc, whole desc, tier, kind_rank, qual_length, repo, path, line nulls first, id"


def _with(tail: str, *more: str) -> str:
    return "with " + ",".join([CORPUS_SQL, *more]) + "\n" + tail


def _matches_sql(words: list[tuple[str, bool]], where: str = "true") -> list[str]:
    """CTEs hits (all matches with ranking columns) and kept (without echoes); words: (norm, path only)."""
    hit = " and ".join(["true", where, *(_prefix("path_norm", w) if p else f"({_prefix('qual_norm', w)} or {_prefix('path_norm', w)})" for w, p in words)])
    named = [w for w, p in words if not p]
    whole = " and ".join(["true", *(_scan("path_norm", w, True) if p else f"({_scan('qual_norm', w, True)} or {_scan('path_norm', w, True)})" for w, p in words)])
    specific = " and ".join(["kind <> 'file'", *(_scan("qual_norm", w, False) for w in named)]) if named else "false"
    term = "_".join(named)
    tier = (
        f"case when name_norm = '{term}' then 0 when starts_with(name_norm, '{term}') then 1 when qual_norm = '{term}' then 2 when starts_with(qual_norm, '{term}') then 3 else 4 end"
        if named else "0"
    )
    rank, length = (_RANK_SQL, "length(qual_norm)") if named else ("0", "0")
    hits = f"""hits as (select s.*, r.name as repo, ({specific}) as specific, ({whole}) as whole, ({tier})::int as tier, ({rank})::int as kind_rank, ({length})::int as qual_length
  from (select s.id, repo_id, line, kind, s.name, scope, name_norm, qual_norm, path, path_norm from symbols s) s join repos r on r.id = s.repo_id where {hit})"""
    kept = "kept as (select * from hits h where not (kind = 'file' and exists (select 1 from hits x where x.specific and x.repo = h.repo and x.path = h.path)))"
    return [hits, kept]


def _search_sql(words: list[tuple[str, bool]], where: str = "true") -> str:
    return _with(f"select {_SHOWN}, specific, whole, tier, kind_rank, qual_length from kept", *_matches_sql(words, where))


def _search(spark: SparkSession, sf_dir: str, text: str, limit: int | None = None) -> DataFrame:
    return search.search(corpus.symbols(spark, sf_dir), corpus.repos(spark, sf_dir), text, limit)


def _with_place(rows: DataFrame) -> DataFrame:
    """Adds the place of each row in the order that an operator returns; for results of few rows."""
    at = F.row_number().over(Window.orderBy("__at")).cast("long")
    return rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("place", at).drop("__at")


# --- functions ---


@_query(f"select p_partkey, p_name, {_norm('p_name')} as norm, {_norm('p_type || p_brand')} as brand_norm from part")
def normalize_names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", "p_name", names.normalize(F.col("p_name")).alias("norm"), names.normalize(F.concat("p_type", "p_brand")).alias("brand_norm"))


@_query(f"select page_id, {_norm('url')} as norm from pages")
def normalize_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", names.normalize(F.col("url")).alias("norm"))


@_query(_with("select id, token from (select id, unnest(string_split(path_norm, '_')) as token from files) where token <> ''"))
def tokens_explode(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("id", F.explode(names.tokens(F.col("path"))).alias("token"))


@_query(_with(f"select id, qual_norm, {_scan('qual_norm', 'ring', False)} as at_boundary, {_prefix('qual_norm', 'ring')} as passes from symbols"))
def boundary_filter(spark, sf_dir):
    q = F.col("qual_norm")
    return corpus.symbols(spark, sf_dir).select("id", "qual_norm", names.contains_at_boundary(q, "ring").alias("at_boundary"), names.boundary_prefix(q, "ring").alias("passes"))


@_query(_with(f"select id, qual_norm from symbols where {_scan('qual_norm', 'gear', True)}"))
def whole_token_filter(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).where(names.contains_whole_tokens(F.col("qual_norm"), "gear")).select("id", "qual_norm")


@_query(_with(f"select id, kind, case when name_norm = 'bolt' then 0 when starts_with(name_norm, 'bolt') then 1 when qual_norm = 'bolt' then 2 when starts_with(qual_norm, 'bolt') then 3 else 4 end::int as tier from symbols"))
def match_quality_tiers(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("id", "kind", names.match_quality(F.col("name_norm"), F.col("qual_norm"), "bolt").cast("int").alias("tier"))


@_query(_with(f"select id, kind, ({_RANK_SQL})::int as kind_rank from symbols"))
def kind_rank_sort(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("id", "kind", names.kind_rank(F.col("kind")).cast("int").alias("kind_rank")).orderBy("kind_rank", "id")


# --- search ---


@_query(_search_sql([("widget", False)]))
def search_word(spark, sf_dir):
    return _search(spark, sf_dir, "widgets")


@_query(_search_sql([("promo", False), ("widget", False)]))
def search_two_words(spark, sf_dir):
    return _search(spark, sf_dir, "promo widget")


@_query(_search_sql([("bolt", False)], "starts_with(lower(r.name), 'nation_1')"))
def search_repo_prefix(spark, sf_dir):
    # The full name NATION_1 isn't matched in lower case, so this takes every repository that begins so.
    return _search(spark, sf_dir, "nation_1: bolt")


@_query(_search_sql([("rod", False)], "kind in ('class', 'const')"))
def search_kind_filter(spark, sf_dir):
    return _search(spark, sf_dir, "@class @cons rod")


@_query(_search_sql([("en_plate", True), ("small", False)]))
def search_path_word(spark, sf_dir):
    return _search(spark, sf_dir, "en/plate small")


@_query(_with(f"select {_SHOWN}, specific, whole, tier, kind_rank, qual_length from hits", *_matches_sql([("fr_ring", True)])))
def search_path_only(spark, sf_dir):
    return _search(spark, sf_dir, "fr/ring")


@_query(_with(f"select {_SHOWN}, row_number() over (order by whole desc, repo, path, line nulls first, id) as place from hits", *_matches_sql([("src1_en_gear", True)])))
def search_plain_order(spark, sf_dir):
    """Without a name word the order is by repository, path and line."""
    return _with_place(_search(spark, sf_dir, "src1/en/gear").select("id", *search.COLUMNS))


@_query(_with(f"select {_SHOWN}, specific, whole, tier, kind_rank, qual_length, row_number() over (order by {_ORDER}) as place from kept", *_matches_sql([("promo", False), ("anvil", False)])))
def search_ranked_order(spark, sf_dir):
    return _with_place(_search(spark, sf_dir, "promo anvil"))


@_query(_with(f"select {_SHOWN}, specific, whole, tier, kind_rank, qual_length, row_number() over (order by {_ORDER}) as rank from kept order by {_ORDER} limit 20", *_matches_sql([("anvil", False)])))
def search_limit_topk(spark, sf_dir):
    symbols, repos = corpus.symbols(spark, sf_dir), corpus.repos(spark, sf_dir)
    rows = search.drop_echoes(search.matches(symbols, repos, parser.parse(repos, "anvil")))
    return search.with_rank(rows, 20).withColumn("rank", F.col("rank").cast("long"))


@_query(_with(f"select {_SHOWN} from hits", *_matches_sql([])))
def search_everything(spark, sf_dir):
    """Every symbol of every repository."""
    return _search(spark, sf_dir, "").select("id", *search.COLUMNS)


@_query(_with(f"select {_SHOWN} from hits", *_matches_sql([], "r.name = 'NATION_3'")))
def search_one_repo(spark, sf_dir):
    """An exact name: not the repositories that only begin so."""
    return _search(spark, sf_dir, "NATION_3:").select("id", *search.COLUMNS)


@_query(_with(f"select {_SHOWN} from hits", *_matches_sql([("ring", False)], "r.name = 'NATION_1'")))
def search_abbreviation(spark, sf_dir):
    symbols, repos = corpus.symbols(spark, sf_dir), corpus.repos(spark, sf_dir)
    parsed = parser.parse(repos, "one: ring", {"one": "NATION_1"})
    return search.matches(symbols, repos, parsed).select("id", *search.COLUMNS)


@_query(_with("select id, repo, path, kind from kept", *_matches_sql([("gizmo", False)])))
def file_echo_drop_anti(spark, sf_dir):
    symbols, repos = corpus.symbols(spark, sf_dir), corpus.repos(spark, sf_dir)
    return search.drop_echoes_anti(search.matches(symbols, repos, parser.parse(repos, "gizmo"))).select("id", "repo", "path", "kind")


@_query(ORACLE_SQL["file_echo_drop_anti"])
def file_echo_drop_window(spark, sf_dir):
    symbols, repos = corpus.symbols(spark, sf_dir), corpus.repos(spark, sf_dir)
    return search.drop_echoes(search.matches(symbols, repos, parser.parse(repos, "gizmo"))).select("id", "repo", "path", "kind")


@_query(_with("select s.id, r.name as repo, path, line, kind, scope, s.name, name_norm, qual_norm, row_number() over (order by r.name) as place from symbols s join repos r on r.id = s.repo_id where kind = 'file' and path = 'README.md'"))
def landing_view(spark, sf_dir):
    return _with_place(search.candidates(corpus.symbols(spark, sf_dir), corpus.repos(spark, sf_dir), ""))


# --- sinks ---


@_query(_with(r"select id, concat_ws(chr(9), repo, path, coalesce(line::varchar, ''), kind, coalesce(scope, ''), name, name_norm, qual_norm) as line_text from kept", *_matches_sql([("plate", False)])))
def tsv_contract(spark, sf_dir):
    return render.tsv(_search(spark, sf_dir, "plate"))


@_query(_with(rf"""select concat_ws(chr(9), repo, path, coalesce(line::varchar, ''), kind, coalesce(scope, ''), name, name_norm, qual_norm) as line_text, n - place + 1 as place
  from (select *, row_number() over (order by {_ORDER}) as place, least(count(*) over (), 12) as n from kept) where place <= 12""", *_matches_sql([("plate", False)])))
def tsv_best_last(spark, sf_dir):
    lines = render.best_last(_search(spark, sf_dir, "plate"), 12)
    return spark.createDataFrame([(t, i) for i, t in enumerate(lines, 1)], "line_text string, place long")


@_query(_with(r"""select id, concat_ws(chr(9), repo, path, coalesce(line::varchar, ''), repo || '@' || kind, concat_ws('::', scope, name),
  case when kind = 'file' then '' else path || coalesce(':' || line, '') end) as feed from kept""", *_matches_sql([("plate", False)])))
def pick_feed(spark, sf_dir):
    return render.pick_feed(_search(spark, sf_dir, "plate"))


@_query(_with("select h.id, r.root || '/' || path || coalesce(':' || line, '') as target from kept h join repos r on r.name = h.repo", *_matches_sql([("rod", False)])))
def selection_target(spark, sf_dir):
    return render.selection_target(_search(spark, sf_dir, "rod"), corpus.repos(spark, sf_dir))


@_query("select id, (i + 1)::int as line_no, case when i = 1 then chr(27) || '[7m' || lines[i + 1] || chr(27) || '[0m' else lines[i + 1] end as text from (select id, lines, unnest(range(len(lines))) as i from (select doc_id as id, string_split(text, chr(10)) as lines from documents where text is not null))")
def preview_lines(spark, sf_dir):
    return render.preview(spark.read.parquet(f"{sf_dir}/documents.parquet"), line=2, sgr="7")


def _spans_sql(column: str, words: list[str]) -> str:
    """Byte spans of the tokens that words touch, as a list of structs: marks by prefixes of what the tokens join to from each on."""
    cut = column
    for pattern in (r"([\p{Ll}])([\p{Lu}])", r"([\p{Lu}])([\p{Lu}][\p{Ll}])", r"(\p{L})([0-9])", r"([0-9])(\p{L})"):
        cut = rf"regexp_replace({cut}, '{pattern}', '\1' || chr(1) || '\2', 'g')"
    cut = rf"regexp_replace({cut}, '([_\-./: \t])', chr(1) || '\1' || chr(1), 'g')"
    pieces = f"list_filter(string_split({cut}, chr(1)), lambda p: p <> '')"
    placed = f"list_transform(range(1, len(p) + 1), lambda i: {{'t': p[i], 'e': list_sum(list_transform(p[1:i], lambda q: strlen(q)))::int}})"
    tokens = rf"list_transform(list_filter({placed}, lambda x: not regexp_full_match(x.t, '[_\-./: \t]')), lambda x: {{'n': {_norm('x.t')}, 's': x.e - strlen(x.t)::int, 'e': x.e}})"
    hits = " or ".join(
        f"len(list_filter(range(greatest(i - {w.count('_')}, 1), i + 1), lambda k: starts_with(array_to_string(list_transform(t[k:], lambda y: y.n), '_'), '{w}'))) > 0" for w in words
    )
    marked = f"list_transform(range(1, len(t) + 1), lambda i: {hits})"
    starts = "list_transform(list_filter(range(1, len(t) + 1), lambda i: m[i] and not coalesce(m[i - 1], false)), lambda i: t[i].s)"
    ends = "list_transform(list_filter(range(1, len(t) + 1), lambda i: m[i] and not coalesce(m[i + 1], false)), lambda i: t[i].e)"
    return f"""(select list_transform(range(1, len(a) + 1), lambda i: {{'start': a[i], 'end': b[i]}}) from
  (select {starts} as a, {ends} as b from (select t, {marked} as m from (select {tokens} as t from (select {pieces} as p)))))"""


_LISTED = "array_to_string(list_transform(spans, lambda s: s.start || '-' || s.end), ',')"


@_query(_with(f"select id, path, {_LISTED} as spans from (select id, path, {_spans_sql('path', ['widget', 'ring', 'fr_widget_guide'])} as spans from files)"))
def match_spans(spark, sf_dir):
    spans = names.match_spans(F.col("path"), ["widget", "ring", "fr_widget_guide"])
    listed = F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return corpus.files(spark, sf_dir).select("id", "path", listed.alias("spans"))


def _painted_sql(column: str, word: str) -> str:
    """Painted text; the names here are ASCII, so that bytes are characters."""
    spans = _spans_sql(column, [word])
    piece = "case when i = 1 then raw[1:spans[1].start] else raw[spans[i - 1].end + 1:spans[i].start] end || chr(27) || '[31m' || raw[spans[i].start + 1:spans[i].end] || chr(27) || '[0m'"
    rest = "raw[coalesce(spans[len(spans)].end, 0) + 1:]"
    return f"(select array_to_string(list_transform(range(1, len(spans) + 1), lambda i: {piece}), '') || {rest} from (select {column} as raw, {spans} as spans))"


@_query(_with(rf"""select id, concat_ws(chr(9), repo, path, coalesce(line::varchar, ''), repo || '@' || kind, {_painted_sql("concat_ws('::', scope, name)", 'widget')},
  case when kind = 'file' then '' else {_painted_sql('path', 'widget')} || coalesce(':' || line, '') end) as feed from kept""", *_matches_sql([("widget", False)])))
def paint_matches(spark, sf_dir):
    return render.pick_feed(_search(spark, sf_dir, "widget"), [parser.Word("widget", False)], "31")


# --- statistics ---

_GLOBAL = "per as (select r.*, (select count(*) from files f where f.repo_id = r.id) as files, (select count(*) from symbols s where s.repo_id = r.id) as symbols from repos r)"


def _per_repo(spark, sf_dir):
    return stats.stats_global(corpus.repos(spark, sf_dir), corpus.files(spark, sf_dir), corpus.symbols(spark, sf_dir))


@_query(_with("select *, row_number() over (order by name) as place from per", _GLOBAL))
def stats_global(spark, sf_dir):
    return _with_place(_per_repo(spark, sf_dir))


@_query(_with("select count(*) as repos, sum(files)::bigint as files, sum(symbols)::bigint as symbols from per", _GLOBAL))
def stats_totals(spark, sf_dir):
    return stats.stats_totals(_per_repo(spark, sf_dir))


@_query(_with("select max(length(name))::int as name_width, max(length(files::varchar))::int as files_width, max(length(symbols::varchar))::int as symbols_width, max(length(root))::int as root_width from per", _GLOBAL))
def stats_widths(spark, sf_dir):
    return stats.column_widths(_per_repo(spark, sf_dir))


@_query(_with("select kind, count(*) as n, row_number() over (order by count(*) desc, kind) as place from symbols where repo_id = 4 group by kind"))
def stats_kind_breakdown(spark, sf_dir):
    return _with_place(stats.kind_breakdown(corpus.symbols(spark, sf_dir), 4))


@_query(_with("""select s.id, repo_id, r.name as repo, path, line, kind, s.name, row_number() over (partition by repo_id, path order by line nulls first, s.id) = 1 as header,
  row_number() over (order by r.name, path, line nulls first, s.id) as place
  from symbols s join repos r on r.id = s.repo_id where repo_id in (2, 12) and kind in ('class', 'method')"""))
def stats_file_listing(spark, sf_dir):
    return _with_place(stats.file_listing(corpus.repos(spark, sf_dir), corpus.symbols(spark, sf_dir), [2, 12], ["class", "method"]))


_TABLES = ("repos", "files", "symbols")


def _stats(spark, sf_dir, *args, **options) -> DataFrame:
    return stats.stats(*(getattr(corpus, t)(spark, sf_dir) for t in _TABLES), *args, **options)


@_query(_with("""select id, name, 'Repo name: ' || name || chr(10) || 'Repo path: ' || root || chr(10) || 'Head commit: ' || case when head is null then 'none' when dirty then head || ' (dirty)' else head end
  || chr(10) || 'Files: ' || files || chr(10) || 'Symbols: ' || symbols || chr(10) || 'Symbol kinds:' || chr(10) || coalesce(listed, '') as block
from per left join (select repo_id, string_agg('  ' || kind || ': ' || n || chr(10), '' order by n desc, kind) as listed from (select repo_id, kind, count(*) as n from symbols group by all) group by repo_id) on repo_id = id
where starts_with(lower(name), 'nation_2')""", _GLOBAL))
def stats_detail(spark, sf_dir):
    """The detail blocks of the repositories that a name's beginning stands for; NATION_2 in another case isn't the exact name."""
    return _stats(spark, sf_dir, "Nation_2")


@_query(_with("""select s.id, repo_id, r.name as repo, path, line, kind, s.name, row_number() over (partition by repo_id, path order by line nulls first, s.id) = 1 as header
  from symbols s join repos r on r.id = s.repo_id where r.name = 'NATION_7'"""))
def stats_files_of_repo(spark, sf_dir):
    return _stats(spark, sf_dir, "NATION_7", list_files=True)


def _error(spark, use) -> DataFrame:
    try:
        use()
        message = ""
    except parser.QueryError as e:
        message = str(e)
    return spark.createDataFrame([(message,)], "message string")


@_query(_with("select 'no symbols of kind ''cla'' (kinds: ' || string_agg(distinct kind, ', ' order by kind) || ')' as message from symbols where repo_id = 7"))
def stats_kind_error(spark, sf_dir):
    """Kinds of a listing are literal; one that no symbol has is an error with the kinds there are."""
    return _error(spark, lambda: _stats(spark, sf_dir, "NATION_7", kinds=["cla"]))


@_query(_with("select 'unknown repository ''nowhere'' (known: ' || string_agg(distinct name, ', ' order by name) || ')' as message from repos"))
def unknown_repo_error(spark, sf_dir):
    return _error(spark, lambda: _search(spark, sf_dir, "nowhere: x"))


@_query("""select q, message from (values ('@x y', 'unknown kind ''@x'' (kinds: class, module, method, smethod, const, func, target, key, heading, image, arg, env, file)'),
  ('@m y', 'ambiguous kind ''@m'' (matches: module, method)'), ('@c', 'ambiguous kind ''@c'' (matches: class, const)'), ('@MeTh', '')) as t(q, message)""")
def kind_errors(spark, sf_dir):
    rows = [(q, _error(spark, lambda q=q: parser.parse(corpus.repos(spark, sf_dir), q)).first().message) for q in ("@x y", "@m y", "@c", "@MeTh")]
    return spark.createDataFrame(rows, "q string, message string")

@_query(_with("select id, name, root, case when head is null then 'none' when dirty then head || ' (dirty)' else head end as head_text from repos"))
def stats_detail_head(spark, sf_dir):
    return stats.head_text(corpus.repos(spark, sf_dir))


@_query(_with("select distinct kind from symbols"))
def distinct_kinds(spark, sf_dir):
    return corpus.symbols(spark, sf_dir).select("kind").distinct().orderBy("kind")


@_query(_with("select distinct name from repos"))
def distinct_repo_names(spark, sf_dir):
    return corpus.repos(spark, sf_dir).select("name").distinct().orderBy("name")


# --- refresh ---

_STATES = """stored as (select repo_id, path, id * 1000 as mtime_ns, size from files where id % 11 <> 0),
current as (select repo_id, path, case when id % 6 = 0 then id * 1000 + 1 else id * 1000 end as mtime_ns, case when id % 10 = 3 then size + 1 else size end as size from files where id % 13 <> 0)"""


def _states(spark, sf_dir):
    f, i = corpus.files(spark, sf_dir), F.col("id")
    stored = f.where(i % 11 != 0).select("repo_id", "path", (i * 1000).alias("mtime_ns"), "size")
    current = f.where(i % 13 != 0).select(
        "repo_id", "path", F.when(i % 6 == 0, i * 1000 + 1).otherwise(i * 1000).alias("mtime_ns"), F.when(i % 10 == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size")
    )
    return current, stored


@_query(_with("select c.* from current c left join stored s on s.repo_id = c.repo_id and s.path = c.path where s.path is null or s.mtime_ns <> c.mtime_ns or s.size <> c.size", _STATES))
def diff_changed(spark, sf_dir):
    return diff.changed_files(*_states(spark, sf_dir))


@_query(_with("select s.* from stored s where not exists (select 1 from current c where c.repo_id = s.repo_id and c.path = s.path)", _STATES))
def diff_removed(spark, sf_dir):
    current, stored = _states(spark, sf_dir)
    return diff.removed_files(stored, current)


_FOUND = "found as (select id, name || '-now' as name, root, case when id % 4 = 1 then 'moved' else head end as head, id % 6 = 0 as dirty from repos where id % 8 <> 2)"


def _found(spark, sf_dir):
    i = F.col("id")
    return corpus.repos(spark, sf_dir).where(i % 8 != 2).select(
        "id", F.concat("name", F.lit("-now")).alias("name"), "root", F.when(i % 4 == 1, "moved").otherwise(F.col("head")).alias("head"), (i % 6 == 0).alias("dirty")
    )


@_query(_with("select f.* from found f where not exists (select 1 from repos r where r.root = f.root and r.head is not distinct from f.head and not r.dirty and not f.dirty)", _FOUND))
def diff_fast_path(spark, sf_dir):
    return diff.repos_to_scan(_found(spark, sf_dir), corpus.repos(spark, sf_dir))


@_query(_with("select r.* from repos r where not exists (select 1 from found f where f.root = r.root)", _FOUND))
def prune_repos(spark, sf_dir):
    return diff.vanished_repos(corpus.repos(spark, sf_dir), _found(spark, sf_dir))


@_query(_with("select r.id, coalesce(f.name, r.name) as name, r.root, r.head, r.dirty from repos r left join found f on f.root = r.root", _FOUND))
def rename_repos(spark, sf_dir):
    return diff.renamed(_found(spark, sf_dir), corpus.repos(spark, sf_dir))


# --- paths ---

_EXT = [
    "rb", "Makefile", "Dockerfile.dev", "x.RB", "tsx", "pyi", "tar.gz", "Gemfile", "mk", "h", "yaml", "markdown", "cjs", "none", "erl", "rs",
    "rake", "gemspec", "sh", "bash", "hrl", "c", "yml", "md", "dockerfile", "js", "jsx", "mjs", "ts", "mts", "cts", "py",
]


def _names_of_parts(spark, sf_dir):
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*map(F.lit, _EXT)), (k % 32 + 1).cast("int"))
    name = F.when(k % 32 < 20, F.concat(F.lit("src/"), F.when((k % 32).isin(1, 2, 7), ending).otherwise(F.concat(F.lit("a."), ending)))).otherwise(F.concat(F.lit("a b."), ending))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k, name.alias("path"))


_NAMES_SQL = f"""named as (select p_partkey, case when p_partkey % 32 < 20 then 'src/' || case when p_partkey % 32 in (1, 2, 7) then e else 'a.' || e end else 'a b.' || e end as path
  from (select p_partkey, ({_list(_EXT)})[p_partkey % 32 + 1] as e from part))"""


_LANG_SQL = """case when base in ('Makefile', 'GNUmakefile', 'makefile') then 'make' when base in ('Rakefile', 'Gemfile', 'config.ru') then 'ruby'
  when base = 'Dockerfile' or starts_with(base, 'Dockerfile.') then 'dockerfile' when not contains(base, '.') then null
  else case string_split(base, '.')[-1] when 'rb' then 'ruby' when 'rake' then 'ruby' when 'gemspec' then 'ruby' when 'sh' then 'bash' when 'bash' then 'bash' when 'rs' then 'rust'
  when 'erl' then 'erlang' when 'hrl' then 'erlang' when 'c' then 'c' when 'h' then 'c' when 'mk' then 'make' when 'yml' then 'yaml' when 'yaml' then 'yaml'
  when 'md' then 'markdown' when 'markdown' then 'markdown' when 'dockerfile' then 'dockerfile' when 'js' then 'javascript' when 'jsx' then 'javascript' when 'mjs' then 'javascript'
  when 'cjs' then 'javascript' when 'ts' then 'typescript' when 'mts' then 'typescript' when 'cts' then 'typescript' when 'tsx' then 'tsx' when 'py' then 'python' when 'pyi' then 'python' end end"""


@_query(f"with {_NAMES_SQL} select p_partkey, path, {_LANG_SQL} as lang from (select *, string_split(path, '/')[-1] as base from named)")
def lang_detect(spark, sf_dir):
    return _names_of_parts(spark, sf_dir).select("p_partkey", "path", paths.detect_language(F.col("path")).alias("lang"))


_SHEBANGS = ["#!/bin/sh", "#!/usr/bin/env python3.11", "#!/usr/bin/ruby2.7 -w", "#! /bin/zsh", "/bin/sh", "#!/usr/bin/perl", "#!/usr/bin/env bash", "#!"]
_SHEBANG_LANGS = {0: "bash", 1: "python", 2: "ruby", 3: "bash", 6: "bash"}


@_query("select p_partkey, case p_partkey % 8 " + " ".join(f"when {k} then '{v}'" for k, v in _SHEBANG_LANGS.items()) + " end as lang from part")
def shebang_detect(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.element_at(F.array(*map(F.lit, _SHEBANGS)), (k % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k, paths.shebang_language(line).alias("lang"))


@_query(_with("select id, path, contains('/' || path || '/', '/src3/en/') or regexp_matches(path, '^[^/]*/fr/ring[^/]*$') or regexp_matches(path, 'Guide[0-9]*7\\.md$') as ignored from files"))
def ignore_match(spark, sf_dir):
    entries = ["/src3/en/", "glob:*/fr/ring*", r"regex:Guide[0-9]*7\.md$"]
    return corpus.files(spark, sf_dir).select("id", "path", paths.ignored(F.col("path"), entries).alias("ignored"))


_MODES = ["100644", "100755", "120000", "160000"]


@_query("select p_partkey, p_partkey % 4 < 2 as regular from part")
def regular_file_mode(spark, sf_dir):
    k = F.col("p_partkey")
    mode = paths.octal(F.element_at(F.array(*map(F.lit, _MODES)), (k % 4 + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k, paths.is_regular_file(mode).alias("regular"))


# --- extraction ---


@_query(r"""select doc_id, line, 'heading' as kind, name from
  (select doc_id, i as line, trim(regexp_replace(trim(lines[i], ' ' || chr(9) || chr(13)), '(^|[ \t]+)#+$', ''), ' ' || chr(9)) as name
   from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from documents)))
where not regexp_full_match(name, '#*')""")
def heading_extract(spark, sf_dir):
    """Every line of every document as a heading of its own."""
    content = F.concat(F.lit("## "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## "))).cast("binary")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("markdown").alias("lang"), content.alias("content"))
    return extract_symbols(rows).select("doc_id", "line", "kind", F.trim(F.col("name"), F.lit(" \t")).alias("name"))


def _quoted(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def _extraction(lang: str):
    source, rows = SAMPLES[lang]
    values = ", ".join(f"({i}, {line}, '{kind}', {_quoted(name)}, {_quoted(scope)})" for i, (line, kind, name, scope) in enumerate(rows))
    number = lambda c: f"replace({c}, '{{k}}', p_partkey::varchar)"
    sql = f"select p_partkey, '{lang}' as lang, ordinal, line, kind, {number('name')} as name, {number('scope')} as scope from part, (values {values}) as t(ordinal, line, kind, name, scope)"

    def query(spark, sf_dir):
        content = F.replace(F.lit(source), F.lit("{k}"), F.col("p_partkey").cast("string")).cast("binary")
        files = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit(lang).alias("lang"), content.alias("content"))
        return extract_symbols(files).select("p_partkey", "lang", "ordinal", "line", "kind", "name", "scope")

    query.__name__ = f"extract_symbols_{lang}"
    return _query(sql)(query)


for _lang in SAMPLES:
    _extraction(_lang)
