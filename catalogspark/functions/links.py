"""Link columns. Hosts are parameters; only the path encoding is fixed."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import full_name, relative_path

# Characters that URI-component encoding leaves alone but form
# encoding escapes, and the reserved characters whole-URI encoding also leaves alone.
COMPONENT_SAFE = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
URI_RESERVED = {
    "%3B": ";", "%2C": ",", "%2F": "/", "%3F": "?", "%3A": ":", "%40": "@",
    "%26": "&", "%3D": "=", "%2B": "+", "%24": "$", "%23": "#",
}


@dataclass(frozen=True)
class LinkTargets:
    """Where records, their mirror and their text renditions live."""

    base: str = "https://files.example.org/datasets"
    primary_host: str = "files.example.org"
    mirror_host: str = "mirror.example.org"
    text_base: str = "https://text.example.org/txt"


def _unescape(encoded: Column, table: dict) -> Column:
    for code, char in table.items():
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def encode_component(text: Column) -> Column:
    return _unescape(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), COMPONENT_SAFE)


def encode_uri(text: Column) -> Column:
    return _unescape(encode_component(text), URI_RESERVED)


def encode_path(path: Column) -> Column:
    """Percent-encode every segment, keeping the slashes between them."""
    return F.replace(encode_component(path), F.lit("%2F"), F.lit("/"))


def _record_link(repo: Column, path: Column, verb: str, targets: LinkTargets) -> Column:
    return F.concat(
        F.lit(targets.base + "/"), F.coalesce(repo, F.lit("")), F.lit(f"/{verb}/main/"), encode_path(path)
    )


def _explicit_or(explicit: Column | None, built: Column) -> Column:
    if explicit is None:
        return built
    return F.coalesce(F.nullif(explicit, F.lit("")), built)


def direct_link(repo, folder, file, ext, explicit=None, targets=LinkTargets()) -> Column:
    path = relative_path(folder, file, ext)
    return _explicit_or(explicit, _record_link(repo, path, "resolve", targets))


def browse_link(repo, folder, file, ext, explicit=None, targets=LinkTargets()) -> Column:
    path = relative_path(folder, file, ext)
    return _explicit_or(explicit, _record_link(repo, path, "blob", targets))


def mirror_link(url: Column, targets=LinkTargets()) -> Column:
    """Swap the host when it is exactly the primary one; other URLs stay as they are."""
    host = targets.primary_host.replace(".", "[.]")
    return F.regexp_replace(
        url, rf"^(?i)(https?://(?:[^/?#@]*@)?){host}(?=[:/?#]|$)", "$1" + targets.mirror_host
    )


def text_link(folder, file, ext, has_txt, targets=LinkTargets()) -> Column:
    """Link of the text rendition: extension dropped, dots inside folder names kept."""
    stem = F.regexp_replace(relative_path(folder, file, ext), r"[.][^./]*$", "")
    link = F.concat(F.lit(targets.text_base + "/"), encode_uri(stem), F.lit(".txt"))
    return F.when(has_txt & (stem != ""), link)


def browser_file_name(name: Column, ext: Column) -> Column:
    """Append the extension unless the name already carries it in any case."""
    name = F.coalesce(F.nullif(name, F.lit("")), F.lit("file"))
    suffix = F.concat(F.lit("."), F.lower(ext))
    return F.when(F.endswith(F.lower(name), suffix), name).otherwise(full_name(name, ext))


def browser_file_link(repo, folder_path, name, ext, explicit=None, targets=LinkTargets()) -> Column:
    file_name = browser_file_name(name, ext)
    path = F.when(folder_path == "", file_name).otherwise(F.concat(folder_path, F.lit("/"), file_name))
    link = F.when(repo != "", _record_link(repo, path, "resolve", targets)).otherwise("")
    return _explicit_or(explicit, link)
