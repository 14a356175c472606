"""DuckDB statements with the results the registered queries must give."""

PART = """cat AS (
  SELECT p_partkey AS ord, concat('shop/', p_brand) AS repo, p_name AS file,
    CASE p_partkey % 7 WHEN 0 THEN 'PDF' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' WHEN 3 THEN 'epub'
                       WHEN 4 THEN 'zip' WHEN 5 THEN '' ELSE 'djvu' END AS ext,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_type
                       ELSE concat(p_type, '/size ', CAST(p_size AS VARCHAR)) END AS folder_path,
    CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 0
         ELSE CAST(floor(p_retailprice * 1000) AS BIGINT) END AS size,
    p_partkey % 3 = 0 AS has_txt
  FROM part)"""

DOCS = """cat AS (
  SELECT d.doc_id AS ord, concat('corpus/', source) AS repo,
    replace(text, chr(10), ' ') AS file, 'txt' AS ext,
    concat(lang, '/b', CAST(d.doc_id % 7 AS VARCHAR)) AS folder_path,
    n_chars AS size, coalesce(l.quality, 0) = 1 AS has_txt
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PAGES = """cat AS (
  SELECT page_id AS ord, regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo,
    regexp_replace(regexp_extract(p, '([^/]*)$', 1), '[.][^.]*$', '') AS file,
    regexp_extract(p, '[.]([^./]*)$', 1) AS ext,
    regexp_replace(regexp_extract(p, '^(.*)/[^/]*$', 1), '^/+', '') AS folder_path,
    CAST(length(html) AS BIGINT) AS size, page_id % 2 = 0 AS has_txt
  FROM (SELECT *, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS p FROM pages) x)"""

EVENTS = """cat AS (
  SELECT event_id AS ord, concat('log/', event_type) AS repo, event_type AS file, '' AS ext,
    '' AS folder_path, CAST(NULL AS BIGINT) AS size, false AS has_txt
  FROM events)"""

FLAT = "ord, repo, file, ext, folder_path, size, has_txt"
FULL_NAME = "CASE WHEN ext = '' THEN file ELSE concat(file, '.', ext) END"
PATH = f"concat(CASE WHEN folder_path = '' THEN '' ELSE concat(folder_path, '/') END, {FULL_NAME})"
ENCODED = "replace(url_encode({}), '%2F', '/')"
BASE = "https://files.example.org/datasets/"
PARTS = "CASE WHEN folder_path = '' THEN []::VARCHAR[] ELSE string_split(folder_path, '/') END"


def part(sql: str, *more: str) -> str:
    return "WITH " + ", ".join([PART, *more]) + " " + sql


def docs(sql: str, *more: str) -> str:
    return "WITH " + ", ".join([DOCS, *more]) + " " + sql


# Ancestor-or-self prefixes of every record, with depth 0 for the root.
PREFIXES = f"""pre AS (
  SELECT ord, repo, d AS depth, len(f) AS levels, array_to_string(f[1:d], '/') AS path,
    CASE WHEN d > 0 THEN array_to_string(f[1:d-1], '/') END AS parent_path,
    CASE WHEN d > 0 THEN f[d] ELSE regexp_extract(repo, '([^/]*)$', 1) END AS name
  FROM (SELECT ord, repo, f, unnest(range(0, len(f) + 1)) AS d FROM (SELECT ord, repo, {PARTS} AS f FROM cat) a) b)"""

NODES = PREFIXES + """, nodes AS (
  SELECT repo, path, any_value(parent_path) AS parent_path, any_value(name) AS name, any_value(depth) AS depth,
    count(*) AS count, bool_or(depth = levels) AS has_direct_files, bool_or(depth < levels) AS has_children
  FROM pre GROUP BY repo, path)"""

# Distinct tokens with their first position, per scope.
TOKENS = """texts AS (
  SELECT 'all' AS scope, ord, lower(concat(file, ' ', replace(folder_path, '/', ' '))) AS t FROM cat
  UNION ALL SELECT 'file', ord, lower(file) FROM cat),
toks AS (
  SELECT scope, ord, token, min(pos) AS pos FROM (
    SELECT scope, ord, unnest(l) AS token, unnest(range(0, len(l))) AS pos
    FROM (SELECT scope, ord, regexp_extract_all(t, '[a-z0-9]+') AS l FROM texts) a) b
  GROUP BY scope, ord, token)"""

VOCAB = TOKENS + """, counted AS (
  SELECT scope, token, count(*) AS df, min(ord) AS first_ord, arg_min(pos, ord) AS first_pos,
    CASE WHEN regexp_matches(token, '^(0|[1-9][0-9]{0,9})$') AND CAST(regexp_extract(token, '^[0-9]{1,10}') AS BIGINT) < 4294967295
         THEN CAST(token AS BIGINT) END AS num
  FROM toks GROUP BY scope, token),
vocab AS (
  SELECT scope, token, df, row_number() OVER (PARTITION BY scope ORDER BY df DESC, num ASC NULLS LAST, first_ord, first_pos) AS vocab_rank
  FROM counted)"""

# Terms of (scope, token) pairs named "asked": the token itself, or its fuzzy stand-ins.
EXPANDED = """exact AS (
  SELECT a.scope, a.token, a.token AS term, 0 AS term_pos, v.df FROM asked a JOIN vocab v USING (scope, token)),
near AS (
  SELECT a.scope, a.token, v.token AS term, v.df, v.vocab_rank
  FROM asked a JOIN vocab v ON a.scope = v.scope AND levenshtein(a.token, v.token) <= 2
  WHERE NOT EXISTS (SELECT 1 FROM vocab x WHERE x.scope = a.scope AND x.token = a.token)),
capped AS (
  SELECT *, row_number() OVER w - 1 AS term_pos, sum(df) OVER w - df AS before
  FROM near WINDOW w AS (PARTITION BY scope, token ORDER BY vocab_rank)),
terms AS (
  SELECT scope, token, term, term_pos, df FROM exact
  UNION ALL SELECT scope, token, term, term_pos, df FROM capped WHERE before < 200)"""


TYPOS = """typed AS (
  SELECT DISTINCT scope, unnest([concat(substr(token, 1, length(token) // 2), substr(token, length(token) // 2 + 2)),
    concat(token, 's'), substr(token, 1, 2)]) AS token FROM vocab),
asked AS (SELECT * FROM typed WHERE token <> '')"""


def points(token: str, folders: bool = True) -> str:
    hit = "CASE WHEN contains(lower({}), {}) THEN {} ELSE 0 END"
    fields = [("file", 3), ("repo", 1)] + ([("folder_path", 2)] if folders else [])
    return "(" + " + ".join(hit.format(f, token, n) for f, n in fields) + ")"


def score(*tokens: str, folders: bool = True) -> str:
    return "CAST(" + (" + ".join(points(f"'{t}'", folders) for t in tokens) or "0") + " AS BIGINT)"


def token_hits(tokens: list, scope: str = "all") -> str:
    """All tokens present exactly."""
    tests = [f"ord IN (SELECT ord FROM toks WHERE scope = '{scope}' AND token = '{t}')" for t in tokens]
    return " AND ".join(tests)


ALL_FIELDS = "(contains(lower(file), {0}) OR contains(lower(repo), {0}) OR contains(lower(folder_path), {0}))"


def page(order: str, select: str, first: int, last: int) -> str:
    return (
        f"SELECT position, score, ord, file FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS position "
        f"FROM ({select}) h) p WHERE position BETWEEN {first} AND {last}"
    )


def human(size: str) -> str:
    def text(scale: int, digits: int, unit: str) -> str:
        ten = 10**digits
        return f"concat(printf('%.{digits}f', floor(({size}) / {scale}.0 * {ten} + 0.5) / {ten}), ' {unit}')"

    return (
        f"CASE WHEN {size} IS NULL OR {size} = 0 THEN '' WHEN {size} < 1024 THEN concat(CAST({size} AS BIGINT), ' B') "
        f"WHEN {size} < 1048576 THEN {text(1024, 1, 'KB')} WHEN {size} < 1073741824 THEN {text(1048576, 1, 'MB')} "
        f"ELSE {text(1073741824, 2, 'GB')} END"
    )


def compact(size: str) -> tuple:
    def text(scale: int, digits: int) -> str:
        ten = 10**digits
        return (
            f"regexp_replace(printf('%.{digits}f', floor(({size}) / {scale}.0 * {ten} + 0.5) / {ten}), '[.]?0+$', '')"
            if digits == 2 else
            f"regexp_replace(printf('%.1f', floor(({size}) / {scale}.0 * 10 + 0.5) / 10), '[.]0$', '')"
        )

    head = f"CASE WHEN {size} IS NULL OR {size} = 0 THEN "
    value = (
        f"{head}'' WHEN {size} >= 1073741824 THEN {text(1073741824, 2)} WHEN {size} >= 1048576 THEN {text(1048576, 1)} "
        f"WHEN {size} >= 1024 THEN {text(1024, 1)} ELSE CAST(CAST({size} AS BIGINT) AS VARCHAR) END"
    )
    unit = (
        f"{head}'MB' WHEN {size} >= 1073741824 THEN 'GB' WHEN {size} >= 1048576 THEN 'MB' "
        f"WHEN {size} >= 1024 THEN 'KB' ELSE 'B' END"
    )
    return value, unit


def category(ext: str) -> str:
    return f"""CASE
      WHEN lower({ext}) = 'pdf' THEN 'pdf'
      WHEN lower({ext}) IN ('txt', 'mht', 'url', 'vcf', 'hhc') THEN 'text'
      WHEN lower({ext}) IN ('epub', 'mobi', 'azw3', 'fb2', 'djvu', 'chm', 'caj') THEN 'book'
      WHEN lower({ext}) IN ('doc', 'docx', 'odt', 'rtf') THEN 'doc'
      WHEN lower({ext}) IN ('ppt', 'pptx', 'pps') THEN 'ppt'
      WHEN lower({ext}) IN ('xls', 'xlsx') THEN 'xls'
      WHEN lower({ext}) = 'csv' THEN 'csv'
      WHEN lower({ext}) IN ('jpg', 'jpeg', 'png', 'gif', 'tif', 'tiff', 'bmp', 'webp', 'svg') THEN 'image'
      WHEN lower({ext}) IN ('html', 'htm', 'aspx', 'css', 'js', 'xml', 'json', 'ini', 'bat') THEN 'code'
      WHEN lower({ext}) IN ('mp4', 'flv', 'swf', 'rm', 'rmvb', 'wmv', 'mpg', 'mts', 'f4v', 'asx') THEN 'video'
      WHEN lower({ext}) IN ('mp3', 'wav', 'wma', 'ape', 'm4a', 'mpga') THEN 'audio'
      WHEN lower({ext}) IN ('iso', 'msi', 'dat') THEN 'archive'
      WHEN lower({ext}) IN ('db', 'itf') THEN 'database'
      WHEN lower({ext}) IN ('md', 'markdown') THEN 'markdown'
      ELSE 'file' END"""


def records_ids(scope: str) -> str:
    return (
        f"WITH {scope}, n AS (SELECT *, row_number() OVER (PARTITION BY repo, folder_path, file, ext ORDER BY ord) - 1 AS occurrence FROM cat) "
        "SELECT ord, occurrence, concat(repo, chr(31), CASE WHEN folder_path = '' THEN '' ELSE concat(folder_path, '/') END, "
        "file, '/', ext, chr(31), CAST(occurrence AS VARCHAR)) AS record_id FROM n"
    )


FIRST_ROWS = """pages_of AS (
  SELECT 'global' AS mode, '' AS page_repo, count(*) OVER () AS total, row_number() OVER (ORDER BY ord) - 1 AS row, * FROM cat
  UNION ALL
  SELECT 'repo', repo, count(*) OVER (PARTITION BY repo), row_number() OVER (PARTITION BY repo ORDER BY ord) - 1, * FROM cat)"""

ROOT_ENTRIES = f"""tops AS (SELECT *, ({PARTS})[1] AS top FROM cat),
entries AS (
  SELECT repo, 'folder' AS kind, top AS name, count(*) AS count, '' AS ext, CAST(NULL AS BOOLEAN) AS has_txt,
    CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS ord
  FROM tops WHERE folder_path <> '' GROUP BY repo, top
  UNION ALL SELECT repo, 'file', file, NULL, ext, has_txt, size, ord FROM cat WHERE folder_path = '')"""

MARK_ESCAPED = (
    "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
)


def marked(terms: list) -> str:
    out = MARK_ESCAPED
    for t in terms:
        out = f"regexp_replace({out}, '({t})', '<mark>\\1</mark>', 'gi')"
    return out


UNIT_OF = (
    "CASE p_partkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1024.0 WHEN 3 THEN 1048576.0 WHEN 4 THEN 1073741824.0 END"
)

CJK_NAME = "translate(file, 'aeiou', '资本论列宁')"

CUBE = "cube AS (SELECT repo, lower(ext) AS e, count(*) AS n, count(*) FILTER (WHERE has_txt) AS t FROM cat GROUP BY ALL)"

EXT_RANK = """list_position(['pdf', 'txt', 'epub', 'mobi', 'azw3', 'fb2', 'djvu', 'chm', 'caj', 'doc', 'docx', 'odt', 'rtf', 'ppt', 'xlsx',
  'jpg', 'png', 'gif', 'tif', 'html', 'htm', 'aspx', 'css', 'js', 'xml', 'mht', 'mp4', 'flv', 'swf', 'rm', 'rmvb', 'mp3', 'wav',
  'iso', 'dat', 'exe'], name)"""

SORT_OF = "CASE query_id % 3 WHEN 0 THEN 'relevance' WHEN 1 THEN 'name' ELSE 'size' END"
BATCH_ORDER = (
    f"PARTITION BY query_id ORDER BY CASE WHEN {SORT_OF} = 'name' THEN file END, "
    f"CASE WHEN {SORT_OF} = 'size' THEN -coalesce(size, 0) END, CASE WHEN {SORT_OF} = 'relevance' THEN -score END, tie, ord"
)


def batch_page(first: int, last: int) -> str:
    return (
        f"SELECT query_id, position, ord, score, total FROM (SELECT *, row_number() OVER ({BATCH_ORDER}) AS position, "
        f"count(*) OVER (PARTITION BY query_id) AS total FROM hits) p WHERE position BETWEEN {first} AND {last}"
    )


def fuzzy_hits(tokens: str) -> str:
    """Hits of queries (query_id, token_pos, token) over the all scope, with score and tie."""
    return (
        VOCAB
        + f", words AS ({tokens}), asked AS (SELECT DISTINCT 'all' AS scope, token FROM words), " + EXPANDED
        + """, held AS (
  SELECT w.query_id, w.token_pos, k.ord, min(t.term_pos) AS term_pos
  FROM words w JOIN terms t ON t.token = w.token JOIN toks k ON k.scope = 'all' AND k.token = t.term GROUP BY ALL),
matched AS (
  SELECT query_id, ord, max(CASE WHEN token_pos = 0 THEN term_pos END) AS tie FROM held h
  GROUP BY query_id, ord HAVING count(*) = (SELECT count(*) FROM words w WHERE w.query_id = h.query_id))"""
    )


LOGGED = """SELECT k AS query_id, unnest([0, 1, 2]) AS token_pos, unnest([CAST(k AS VARCHAR), 'size', 'red']) AS token
  FROM (SELECT DISTINCT CAST(props->>'$.k' AS BIGINT) AS k FROM events) e"""

TOKEN_BATCH = part(
    batch_page(1, 25),
    fuzzy_hits(LOGGED),
    f"""hits AS (
  SELECT m.query_id, m.tie, c.*, CAST((SELECT sum({points('w.token')}) FROM words w WHERE w.query_id = m.query_id) AS BIGINT) AS score
  FROM matched m JOIN cat c USING (ord) WHERE size IS NULL OR size <= 0 OR size >= 905000)""",
)

RECENT = """WITH q AS (SELECT user_id, ts, props->>'$.k' AS q FROM events),
used AS (SELECT user_id, q, max(ts) AS ts FROM q WHERE q <> '' GROUP BY user_id, q)
SELECT * FROM (SELECT user_id, q, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, q) AS rank FROM used) r WHERE rank <= 20"""


def pick(value: float, by: str = "") -> str:
    over = f"PARTITION BY {by}" if by else ""
    return (
        f"SELECT ord, repo, file FROM (SELECT *, row_number() OVER ({over} ORDER BY ord) - 1 AS i, count(*) OVER ({over}) AS n FROM pool) p "
        f"WHERE i = least(n - 1, CAST(floor({value} * n) AS BIGINT))"
    )


def changed(sql: str, *more: str) -> str:
    """Over the part records that are left after half of them came at once, the others in two steps, and some went."""
    return "WITH " + ", ".join([
        PART.replace("cat AS", "whole AS", 1),
        "steps AS (SELECT middle, 1 + (last - middle) // 2 AS step FROM (SELECT (min(ord) + max(ord)) // 2 AS middle, max(ord) AS last FROM whole) s)",
        "cat AS (SELECT w.* FROM whole w, steps WHERE NOT (ord % 10 < 2 AND ord <= middle + (ord % 10) * step))", *more,
    ]) + " " + sql


def facets_of() -> str:
    return (
        "SELECT 'repo' AS facet, repo AS value, count(*) AS count FROM hit GROUP BY repo UNION ALL SELECT 'ext', lower(ext), count(*) FROM hit GROUP BY lower(ext) "
        "UNION ALL SELECT 'text', '', count(*) FROM hit WHERE has_txt HAVING count(*) > 0"
    )


def build() -> dict:
    value, unit = compact("(size * 1000)")
    narrow_value, narrow_unit = compact("floor(size / 1000.0)")
    glued_value, glued_unit = compact("size")
    direct = f"concat('{BASE}', repo, '/resolve/main/', {ENCODED.format(PATH)})"
    upper_name = f"CASE WHEN has_txt THEN upper({FULL_NAME}) ELSE file END"
    browser = f"CASE WHEN ext = '' OR has_txt THEN {upper_name} ELSE concat(file, '.', ext) END"
    leaf_path = f"concat(CASE WHEN folder_path = '' THEN '' ELSE concat(folder_path, '/') END, {browser})"
    stem = f"regexp_replace({PATH}, '[.][^./]*$', '')"
    literal = "SELECT {}, {} AS score FROM cat WHERE {}"
    out = {
        "src1_read_compact_corpus": part(
            "SELECT ord // 300 AS shard, 2 AS version, count(DISTINCT repo) AS repos, count(DISTINCT folder_path) AS folders, count(*) AS records FROM cat GROUP BY ALL"
        ),
        "src2_decode_compact": part(
            "SELECT (ord // 300) * 4294967296 + ord % 300 AS ord, repo, file, ext, folder_path, size, has_txt FROM cat"
        ),
        "src3_read_first_pages": part(
            f"SELECT mode, page_repo, total, row, repo, file, ext, folder_path, size, has_txt FROM pages_of WHERE row < 100", FIRST_ROWS
        ),
        "src4_read_root_listings": part("SELECT repo, kind, name, name AS path, count, ext, has_txt, size FROM entries", ROOT_ENTRIES),
        "src5_replace_corpus": part(f"SELECT {FLAT}, 2 AS generation FROM cat"),
        "src5_changed_records": changed(
            "SELECT ord, occurrence, concat(repo, chr(31), CASE WHEN folder_path = '' THEN '' ELSE concat(folder_path, '/') END, file, '/', ext, chr(31), occurrence) AS record_id "
            "FROM (SELECT *, row_number() OVER (PARTITION BY repo, folder_path, file, ext ORDER BY ord) - 1 AS occurrence FROM cat) c"
        ),
        "src5_changed_vocabulary": changed(
            "SELECT scope, token, count(*) AS df, min(ord) AS first_ord FROM toks GROUP BY scope, token", TOKENS
        ),
        "src5_changed_facets": changed(
            "SELECT repo, lower(ext) AS ext, count(*) AS count, count(*) FILTER (WHERE has_txt) AS txt_count FROM cat GROUP BY 1, 2"
        ),
        "snk1_first_pages": part(
            "SELECT 2 AS version, mode, page_repo, 'relevance' AS sort, 1 AS page, 100 AS page_size, any_value(total) AS total, count(*) AS rows, "
            "string_agg(file, '|' ORDER BY row) AS files FROM pages_of WHERE row < 100 GROUP BY mode, page_repo", FIRST_ROWS
        ),
        "snk2_root_listings": part(
            "SELECT repo, (n - 1) // 25 AS part, coalesce(string_agg(concat(name, '=', count), '|' ORDER BY n) FILTER (WHERE kind = 'folder'), '') AS folders, "
            "coalesce(string_agg(concat(name, '.', ext), '|' ORDER BY n) FILTER (WHERE kind = 'file'), '') AS files "
            "FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY kind DESC, name, ord) AS n FROM entries) e GROUP BY ALL", ROOT_ENTRIES
        ),
        "snk3_manifest": part(
            "SELECT n // 10 AS part, 2 AS version, n % 10 AS row, page_set, page_name FROM ("
            "SELECT 0 AS n, '/data/page_set=global' AS page_set, 'all' AS page_name UNION ALL "
            "SELECT row_number() OVER (ORDER BY url_encode(repo)), '/data/page_set=repo', repo FROM (SELECT DISTINCT repo FROM cat) r) u"
        ),
        "snk4_selected_links": part(f"SELECT ord, {FULL_NAME} AS filename, {direct} AS link FROM cat WHERE has_txt AND ext = 'pdf'"),
        "col1_relative_path": part(f"SELECT ord, {PATH} AS path FROM cat"),
        "col2_links": part(
            f"SELECT ord, {direct} AS direct, replace({direct}, '/resolve/', '/blob/') AS browse, "
            f"CASE WHEN has_txt THEN concat('https://e.org/', file) ELSE {direct} END AS explicit FROM cat"
        ),
        "col3_mirror_link": r"SELECT page_id, regexp_replace(url, '^(https?://)thther\.example\.org([:/?#]|$)', '\1mirror.example.org\2') AS mirror FROM pages",
        "col4_text_link": part(
            f"SELECT ord, CASE WHEN has_txt THEN concat('https://text.example.org/txt/', {ENCODED.format(stem)}, '.txt') END AS text FROM cat"
        ),
        "col5_browser_name": part(
            f"SELECT ord, {browser} AS name, concat('{BASE}', repo, '/resolve/main/', {ENCODED.format(leaf_path)}) AS link FROM cat"
        ),
        "col6_human_size": part(
            f"SELECT ord, {human('floor(size / 10000.0)')} AS small, {human('(size * CASE ord % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END)')} AS large FROM cat"
        ),
        "col7_compact_size": part(
            f"SELECT ord, {value} AS value, {unit} AS unit, {narrow_value} AS narrow_value, {narrow_unit} AS narrow_unit, "
            f"CASE WHEN size IS NOT NULL THEN concat({glued_value}, {glued_unit}) END AS glued FROM cat"
        ),
        "col8_parse_size": (
            f"SELECT p_partkey AS ord, CASE WHEN p_partkey % 7 < 5 THEN CAST(floor(p_retailprice * {UNIT_OF} + 0.5) AS BIGINT) ELSE CAST(floor(p_retailprice) AS BIGINT) END AS bytes, "
            "CASE WHEN p_size >= 10 THEN CAST((p_size - 10) AS BIGINT) * 1048576 END AS entered FROM part"
        ),
        "col9_category": (
            f"WITH {PAGES.replace('cat AS', 'pcat AS', 1)}, {PART} SELECT 'pages' AS origin, ord, {category('ext')} AS category FROM pcat "
            f"UNION ALL SELECT 'part', ord, {category('ext')} FROM cat"
        ),
        "col10_breadcrumb": part("SELECT ord, depth - 1 AS depth, name AS label, path FROM pre WHERE depth > 0", PREFIXES),
        "col11_highlight": f"SELECT doc_id, {marked(['An', 'th&#39;', 'ar'])} AS marked FROM documents",
        "col12_record_id": records_ids(PART),
        "col12_record_id_hot_copies": records_ids(EVENTS),
        "col13_clean_path": part("SELECT ord, folder_path AS path, CASE WHEN has_txt THEN folder_path ELSE '' END AS missing FROM cat"),
        "tok1_tokens": "SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM documents",
        "tok1_tokens_cjk": part(
            f"""SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY kind, spot) - 1 AS pos, token FROM (
              SELECT ord, token, min(kind) AS kind, min(spot) AS spot FROM (
                SELECT ord, 1 AS kind, unnest(range(0, len(r))) AS spot, unnest(r) AS token FROM runs
                UNION ALL SELECT ord, 2, i, substr(h, i, 1) FROM (SELECT ord, h, unnest(range(1, length(h) + 1)) AS i FROM runs) a
                UNION ALL SELECT ord, 3, i, substr(h, i, 2) FROM (SELECT ord, h, unnest(range(1, length(h))) AS i FROM runs) b) c
              GROUP BY ord, token) d""",
            f"runs AS (SELECT ord, regexp_extract_all({CJK_NAME}, '[a-z0-9]+') AS r, regexp_replace({CJK_NAME}, '[^资本论列宁]', '', 'g') AS h FROM cat)",
        ),
        "idx1_postings_all": docs("SELECT ord, token FROM toks WHERE scope = 'all'", TOKENS),
        "idx2_postings_file": docs("SELECT ord, token FROM toks WHERE scope = 'file'", TOKENS),
        "idx3_ranked_vocabulary": part("SELECT scope, token, df, vocab_rank FROM vocab", VOCAB),
        "flt1_repo": part(f"SELECT {FLAT} FROM cat WHERE repo IN ('shop/Brand#12', 'shop/Brand#3')"),
        "flt1_repo_short_names": part(f"SELECT {FLAT} FROM cat WHERE repo IN ('shop/Brand#12', 'shop/Brand#3')"),
        "flt2_extension": part(f"SELECT {FLAT} FROM cat WHERE lower(ext) IN ('pdf', 'DJVU', 'txt')"),
        "flt3_folder_exact": part(f"SELECT {FLAT} FROM cat WHERE folder_path IN ('ECONOMY', 'LARGE/size 7')"),
        "flt4_folder_subtree": part(
            f"SELECT {FLAT} FROM cat WHERE folder_path IN ('ECONOMY', 'SMA', '') OR starts_with(folder_path, 'ECONOMY/') OR starts_with(folder_path, 'SMA/')"
        ),
        "flt5_folder_mixed": part(
            f"SELECT {FLAT} FROM cat WHERE folder_path IN ('SMALL', 'LARGE/size 7', 'MEDIUM') OR starts_with(folder_path, 'MEDIUM/')"
        ),
        "flt5_folder_mixed_tables": part(
            f"""SELECT {FLAT} FROM cat c WHERE folder_path <> '' AND (
              EXISTS (SELECT 1 FROM cat o WHERE o.ext = 'pdf' AND o.folder_path = c.folder_path)
              OR EXISTS (SELECT 1 FROM pre p JOIN cat o ON o.folder_path = p.path
                         WHERE p.ord = c.ord AND p.depth > 0 AND o.ext = 'epub' AND o.repo = 'shop/Brand#2'))""", PREFIXES
        ),
        "flt4_folder_numbers": part(
            """SELECT path, row_number() OVER (ORDER BY replace(path, '/', chr(1)), path) AS first,
                 row_number() OVER (ORDER BY replace(path, '/', chr(1)), path) - 1 + (SELECT count(*) FROM paths o WHERE p.path = '' OR o.path = p.path OR starts_with(o.path, concat(p.path, '/'))) AS last
               FROM paths p""", PREFIXES, "paths AS (SELECT DISTINCT path FROM pre)"
        ),
        "flt6_size": part(f"SELECT {FLAT} FROM cat WHERE size IS NULL OR size <= 0 OR size BETWEEN 950000 AND 1000000"),
        "flt7_has_text": part(f"SELECT {FLAT} FROM cat WHERE has_txt"),
        "flt_all_from_query_table": part(
            """SELECT substr(repo, 6) AS brand, ord FROM cat WHERE lower(ext) IN ('pdf', 'txt', 'epub')
               AND (folder_path IN ('ECONOMY', 'SMALL') OR starts_with(folder_path, 'ECONOMY/') OR starts_with(folder_path, 'SMALL/'))
               AND (size IS NULL OR size <= 0 OR size >= 910000)"""
        ),
        "srch1_mode": part(
            """SELECT ord, CASE ord % 5 WHEN 0 THEN 'token' WHEN 1 THEN 'literal' WHEN 2 THEN 'all'
                 WHEN 3 THEN CASE WHEN w THEN 'wildcard' ELSE 'token' END ELSE 'token' END AS mode,
               CASE ord % 5 WHEN 2 THEN 'all' WHEN 3 THEN CASE WHEN w THEN 'wildcard' ELSE 'literal' END ELSE 'literal' END AS exact_mode
               FROM (SELECT *, regexp_matches(file, '[aeiou]') AS w FROM cat) c"""
        ),
        "srch2_literal": part(literal.format("ord, 0 AS tie", score("ed", "r"), ALL_FIELDS.format("'ed r'"))),
        "srch2_literal_documents": docs(
            literal.format("ord, 0 AS tie", score("th", folders=False), "contains(lower(file), 'th.') OR contains(lower(repo), 'th.')")
        ),
        "srch3_wildcard": part(
            literal.format("ord, 0 AS tie", score("r", "d", "g"), " OR ".join(f"regexp_matches(lower({f}), 'r.d.*g')" for f in ("file", "repo", "folder_path")))
        ),
        "srch4_tokens": part(literal.format("ord, 0 AS tie", score("gear", "size", "promo"), token_hits(["gear", "size", "promo"])), TOKENS),
        "srch4_tokens_file_only": docs(
            literal.format("ord, 0 AS tie", score("the", "en", folders=False), token_hits(["the", "en"], "file")), TOKENS
        ),
        "srch5_fuzzy_terms": part("SELECT scope, token, term, term_pos, df FROM terms", VOCAB, TYPOS, EXPANDED),
        "srch5_fuzzy_search": part(
            f"SELECT m.ord, {score('rng', 'bolts')} AS score, m.tie FROM matched m JOIN cat USING (ord)",
            fuzzy_hits("SELECT 0 AS query_id, unnest([0, 1]) AS token_pos, unnest(['rng', 'bolts']) AS token"),
        ),
        "srch6_edit_distance": """SELECT p_partkey AS ord, CASE WHEN d <= 2 THEN d ELSE 999 END AS edits FROM (
            SELECT p_partkey, levenshtein(p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS d FROM part) x WHERE d IS NOT NULL""",
        "srch7_relevance": part(
            f"SELECT ord, CAST(sum({points('t')}) AS BIGINT) AS score, CAST(sum({points('t', False)}) AS BIGINT) AS file_score, CAST(sum({points('t')}) AS BIGINT) AS long_score FROM "
            "(SELECT *, unnest(list_distinct(regexp_extract_all(lower(concat(folder_path, ' shop ', substr(file, 1, 3))), '[a-z0-9]+'))) AS t FROM cat) c GROUP BY ord"
        ),
        "srch8_literal_batch": part(
            batch_page(21, 40),
            f"""asked AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS query_id, lower(p_brand) AS q FROM part),
            hits AS (SELECT a.query_id, 0 AS tie, c.*, {points("'brand'")} + {points("CAST(a.query_id AS VARCHAR)")} AS score
              FROM asked a JOIN cat c ON contains(lower(c.repo), a.q) WHERE lower(ext) IN ('pdf', 'txt', 'epub', 'zip'))""",
        ),
        "srch8_token_batch_by_postings": TOKEN_BATCH,
        "srch8_token_batch_by_scan": TOKEN_BATCH,
        "sort1_relevance": part(
            page("score DESC, ord", literal.format("*", score("small", "gear"), token_hits(["small", "gear"])), 1, 500), TOKENS
        ),
        "sort2_name": part(
            page("file, ord", literal.format("*", score("e"), ALL_FIELDS.format("'e'")), 1, 500)
        ),
        "sort3_size": part(page("coalesce(size, 0) DESC, ord", literal.format("*", score("economy"), ALL_FIELDS.format("'economy'")), 1, 500)),
        "sort4_corpus_order": part(page("ord", literal.format("*", score(), "repo IN ('shop/Brand#7', 'shop/Brand#8')"), 1, 500)),
        "sort5_browse_ranks": part(
            """SELECT ord, row_number() OVER (ORDER BY ord) AS corpus_rank, row_number() OVER (PARTITION BY repo ORDER BY ord) AS repo_corpus_rank,
               row_number() OVER (ORDER BY file, ord) AS name_rank, row_number() OVER (ORDER BY coalesce(size, 0) DESC, ord) AS size_rank,
               row_number() OVER (PARTITION BY repo ORDER BY file, ord) AS repo_name_rank,
               row_number() OVER (PARTITION BY repo ORDER BY coalesce(size, 0) DESC, ord) AS repo_size_rank FROM cat"""
        ),
        "sort5_browse_page": part(
            """SELECT * FROM (
                 SELECT 'relevance' AS sort, '' AS listed, row_number() OVER (ORDER BY ord) AS position, ord FROM cat
                 UNION ALL SELECT 'name', '', row_number() OVER (ORDER BY file, ord), ord FROM cat
                 UNION ALL SELECT 'size', '', row_number() OVER (ORDER BY coalesce(size, 0) DESC, ord), ord FROM cat
                 UNION ALL SELECT 'relevance', repo, row_number() OVER (ORDER BY ord), ord FROM cat WHERE repo = 'shop/Brand#7'
                 UNION ALL SELECT 'name', repo, row_number() OVER (ORDER BY file, ord), ord FROM cat WHERE repo = 'shop/Brand#7'
                 UNION ALL SELECT 'size', repo, row_number() OVER (ORDER BY coalesce(size, 0) DESC, ord), ord FROM cat WHERE repo = 'shop/Brand#7'
               ) x WHERE position BETWEEN 31 AND 60"""
        ),
        "page1_page": part(page("coalesce(size, 0) DESC, ord", literal.format("*", score(), "true"), 81, 120)),
        "page1_filtered_by_bitmaps": part(page("ord", literal.format(
            "*", score(), "repo IN ('shop/Brand#7', 'shop/Brand#8') AND lower(ext) IN ('pdf', 'txt', 'zip')"), 5, 8)),
        "page1_clamp": """SELECT p_partkey AS ord, CAST(CASE WHEN p_size = 5 THEN 100 ELSE greatest(1, least(500, p_size * 20 - 100)) END AS BIGINT) AS page_size,
            CAST(greatest(1, p_size - 10) AS BIGINT) AS page FROM part""",
        "agg1_repo": part("SELECT repo, count(*) AS count FROM cat GROUP BY repo"),
        "agg2_extension": part("SELECT lower(ext) AS ext, count(*) AS count FROM cat WHERE ext <> '' GROUP BY 1"),
        "agg3_extension_by_repo": part("SELECT repo, lower(ext) AS ext, count(*) AS count FROM cat WHERE ext <> '' GROUP BY 1, 2"),
        "agg4_text": part(
            "SELECT '' AS repo, count(*) AS count, count(*) > 0 AS available FROM cat WHERE has_txt UNION ALL SELECT repo, count(*), true FROM cat WHERE has_txt GROUP BY repo"
        ),
        "agg3_facets_of_filtered": part(
            facets_of(), "hit AS (SELECT * FROM cat WHERE repo IN ('shop/Brand#7', 'shop/Brand#8', 'shop/Brand#12') AND lower(ext) IN ('pdf', 'epub') AND has_txt)"
        ),
        "agg3_facets_of_tokens": part(
            facets_of(), TOKENS, f"hit AS (SELECT * FROM cat WHERE {token_hits(['gear', 'size'])} AND lower(ext) IN ('pdf', 'txt', 'zip'))"
        ),
        "agg3_facets_of_size_range": part(
            facets_of(), TOKENS, f"hit AS (SELECT * FROM cat WHERE {token_hits(['red'])} AND (size IS NULL OR size <= 0 OR size >= 950000))"
        ),
        "agg5_metadata": part(
            """SELECT 'total' AS facet, '' AS repo, '' AS name, CAST(sum(n) AS BIGINT) AS count FROM cube
               UNION ALL SELECT 'repo', repo, '', CAST(sum(n) AS BIGINT) FROM cube GROUP BY repo
               UNION ALL SELECT 'extension', '', e, CAST(sum(n) AS BIGINT) FROM cube WHERE e <> '' GROUP BY e
               UNION ALL SELECT 'extension_by_repo', repo, e, n FROM cube WHERE e <> ''
               UNION ALL SELECT 'text', '', '', CAST(sum(t) AS BIGINT) FROM cube
               UNION ALL SELECT 'text', repo, '', CAST(sum(t) AS BIGINT) FROM cube GROUP BY repo HAVING sum(t) > 0""", CUBE
        ),
        "agg5_metadata_empty": "SELECT unnest(['total', 'text']) AS facet, 0 AS count",
        "agg6_extension_panel": (
            f"WITH {PAGES.replace('cat AS', 'pcat AS', 1)}, {PART}, shown AS (SELECT name, max(c) AS c FROM "
            "(SELECT lower(ext) AS name, count(*) AS c FROM cat WHERE ext <> '' GROUP BY 1 UNION ALL SELECT DISTINCT lower(ext), 0 FROM pcat WHERE ext <> '') u GROUP BY name), "
            f"ranked AS (SELECT name, c, {EXT_RANK} AS r FROM shown) "
            "SELECT row_number() OVER (ORDER BY major, ext) AS position, kind, ext, kinds, count FROM ("
            "SELECT r AS major, 'known' AS kind, name AS ext, 1 AS kinds, c AS count FROM ranked WHERE r IS NOT NULL "
            "UNION ALL SELECT 1002, 'other_child', name, 1, c FROM ranked WHERE r IS NULL "
            "UNION ALL SELECT 1001, 'other', '', count(*), CAST(sum(c) AS BIGINT) FROM ranked WHERE r IS NULL HAVING count(*) > 0) p"
        ),
        "agg7_complement": part(
            "SELECT DISTINCT lower(ext) AS ext FROM cat WHERE ext <> '' EXCEPT SELECT lower(ext) FROM cat WHERE ext LIKE '%p%'"
        ),
        "agg7_folder_complement": part(
            "SELECT repo, 'subtree' AS kind, path FROM nodes WHERE depth > 0 AND length(path) <= 12 "
            "UNION ALL SELECT repo, 'self', path FROM nodes WHERE depth > 0 AND has_direct_files", NODES
        ),
        "hier1_folder_contents": part(
            f"""SELECT 'folder' AS kind, ({PARTS})[2] AS name, concat('MEDIUM/', ({PARTS})[2]) AS path, count(*) AS count, '' AS ext, CAST(NULL AS BIGINT) AS size
               FROM cat WHERE repo = 'shop/Brand#13' AND starts_with(folder_path, 'MEDIUM/') GROUP BY ALL
               UNION ALL SELECT 'file', file, '', NULL, ext, nullif(size, 0) FROM cat WHERE repo = 'shop/Brand#13' AND folder_path = 'MEDIUM'"""
        ),
        "hier1_all_listings": part(
            "SELECT repo, parent_path AS path, 'folder' AS kind, name, count, '' AS ext, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS ord FROM nodes WHERE depth > 0 "
            "UNION ALL SELECT repo, folder_path, 'file', file, NULL, ext, size, ord FROM cat", NODES
        ),
        "hier2_folder_tree": part(
            "SELECT repo, path, coalesce(parent_path, '-') AS parent_path, name, depth, count, has_direct_files, has_children, "
            "depth > 0 AND has_direct_files AND has_children AS show_self_toggle, depth = 0 AS is_root FROM nodes", NODES
        ),
        "hier3_ancestors": part("SELECT ord, path AS ancestor FROM pre WHERE depth > 0", PREFIXES),
        "smp1_random_per_repo": part(pick(0.37, "repo"), "pool AS (SELECT * FROM cat)"),
        "smp1_random_text": part(pick(0.81), "pool AS (SELECT * FROM cat WHERE has_txt)"),
        "log1_recent_queries": RECENT,
        "log1_recent_queries_stream": RECENT,
    }
    # The same answers by way of stored blocks, bitmaps and intervals.
    for key in ("srch2_literal", "srch2_literal_documents", "srch3_wildcard", "srch4_tokens", "srch4_tokens_file_only", "srch5_fuzzy_search"):
        out[key + "_by_blocks"] = out[key]
    for key in ("flt4_folder_subtree", "flt5_folder_mixed", "hier1_folder_contents"):
        out[key + "_by_interval"] = out[key]
    for key in ("smp1_random_per_repo", "smp1_random_text"):
        out[key + "_by_bitmaps"] = out[key]
    return out


ORACLE = build()
