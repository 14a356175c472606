"""Schemas shared by every job (DDL strings, so readers never infer)."""

CATALOG = (
    "ord BIGINT, repo STRING, file STRING, ext STRING, "
    "folder ARRAY<STRING>, size BIGINT, has_txt BOOLEAN"
)

# Wire form: dictionaries of repos and folders, then one mixed-type array per record.
COMPACT = "v INT, rp ARRAY<STRING>, fd ARRAY<ARRAY<STRING>>, rc ARRAY<VARIANT>"

FIRST_PAGE = (
    "version BIGINT, mode STRING, repo STRING, sort STRING, page BIGINT, "
    "page_size BIGINT, total BIGINT, "
    "results ARRAY<STRUCT<Repo STRING, File STRING, Extension STRING, "
    "Folder ARRAY<STRING>, Size BIGINT, HasTxt BOOLEAN>>"
)

ROOT_LISTING = (
    "repo STRING, path STRING, "
    "folders ARRAY<STRUCT<n STRING, c BIGINT>>, "
    "files ARRAY<STRUCT<n STRING, e STRING, t BOOLEAN, s BIGINT>>"
)

REPO_COUNTS = "repos ARRAY<STRUCT<name STRING, count BIGINT>>"

MANIFEST = "version BIGINT, urls ARRAY<STRING>"

QUERY = (
    "query_id BIGINT, q STRING, exact BOOLEAN, search_folders BOOLEAN, "
    "repos ARRAY<STRING>, extensions ARRAY<STRING>, folders ARRAY<STRING>, "
    "folder_match_mode STRING, folder_selfs ARRAY<STRING>, folder_subtrees ARRAY<STRING>, "
    "min_size BIGINT, max_size BIGINT, sort STRING, page INT, page_size INT"
)

FILTER_FIELDS = (
    "repos", "extensions", "folders", "folder_match_mode",
    "folder_selfs", "folder_subtrees", "min_size", "max_size",
)
