"""Paths, identifiers, URLs and hashes as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extension -> language.
LANGUAGE_OF_EXTENSION = {
    "py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "cs": "csharp", "go": "go", "rs": "rust",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "php": "php", "rb": "ruby", "kt": "kotlin", "kts": "kotlin", "scala": "scala",
    "sc": "scala", "swift": "swift", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown",
    "sql": "sql", "sh": "bash", "bash": "bash", "zsh": "bash", "r": "r", "lua": "lua", "vim": "vim", "el": "elisp", "clj": "clojure", "ex": "elixir",
    "exs": "elixir", "erl": "erlang", "hrl": "erlang", "hs": "haskell", "ml": "ocaml", "nim": "nim", "pl": "perl", "pm": "perl", "proto": "proto", "thrift": "thrift",
}


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Without the dot, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(filename(path), r"[^.]\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of the extension, null if unknown."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGE_OF_EXTENSION.items() for x in kv])[extension(path)]


def under(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies in it; /a/bc does not lie in /a/b."""
    f = F.regexp_replace(folder, "/+$", "")
    return (path == f) | path.startswith(F.concat(f, F.lit("/")))


def detach(path: Column, root: Column) -> Column:
    """The path relative to a root, if it lies in it."""
    r = F.regexp_replace(root, "/+$", "")
    return F.when(path.startswith(F.concat(r, F.lit("/"))), F.substring(path, F.length(r) + 2, F.length(path))).otherwise(path)


def attach(path: Column, root: Column) -> Column:
    """A relative path below a root; an absolute one as it is."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path))


def remap(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose old prefix is the path or a folder of it replaces that prefix."""
    out = path
    for old, new in reversed(rules):
        o = old.rstrip("/")
        out = F.when(under(path, F.lit(o)), F.concat(F.lit(new.rstrip("/")), F.substring(path, F.lit(len(o) + 1), F.length(path)))).otherwise(out)
    return out


def strip_credentials(url: Column) -> Column:
    """An http(s) URL without user, password or fragmentary host case; other URLs as they are."""
    return F.regexp_replace(url, r"^(https?://)[^/@]*@", "$1")


def project_of(url: Column, root: Column) -> Column:
    """The URL's last part without .git, else the folder's name."""
    bare = F.regexp_replace(url, r"\.git$", "")
    last = F.when(bare.contains("/"), F.regexp_extract(bare, r"([^/]*)$", 1)).when(bare.contains(":"), F.regexp_extract(bare, r"([^:]*)$", 1)).otherwise("")
    return F.when(F.coalesce(last, F.lit("")) != "", last).otherwise(filename(F.regexp_replace(root, "/+$", "")))


def version_id(name: Column, branch: Column, commit: Column) -> Column:
    """name#branch@7 digits; ``unknown`` without a commit."""
    c = F.when(F.coalesce(commit, F.lit("")) == "", "unknown").otherwise(F.substring(commit, 1, 7))
    return F.concat(name, F.lit("#"), branch, F.lit("@"), c)


def row_id(*parts: Column) -> Column:
    """A deterministic id of a row's natural key; nulls and empty strings differ."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("\u0001")) for p in parts]), 256)


def document_id(identifier: Column, path: Column, name: Column, line: Column) -> Column:
    """A store-safe id: parts cut to 100, 200 and 100 characters, other characters as underscores, 511 at most."""
    safe = lambda c, n: F.substring(F.regexp_replace(c, r"[^a-zA-Z0-9_-]", "_"), 1, n)
    joined = F.concat_ws("_", safe(identifier, 100), safe(path, 200), safe(name, 100), line.cast("string"))
    return F.substring(F.regexp_replace(joined, "_+", "_"), 1, 511)


def content_hash(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


@F.pandas_udf(T.StringType())
def quick_hash(mtime_ms: pd.Series, size: pd.Series) -> pd.Series:
    """xxh64 (seed 0) of "<ms>:<size>" as other tools write it; null if either is null."""
    import xxhash

    return pd.Series([None if pd.isna(m) or pd.isna(s) else xxhash.xxh64_hexdigest(f"{int(m)}:{int(s)}") for m, s in zip(mtime_ms, size, strict=True)])


@F.pandas_udf(T.StringType())
def file_hash(data: pd.Series) -> pd.Series:
    """xxh64 (seed 0) of bytes."""
    import xxhash

    return pd.Series([None if b is None else xxhash.xxh64_hexdigest(b) for b in data])


@F.pandas_udf(T.StringType())
def text_hash(text: pd.Series) -> pd.Series:
    """xxh3-128 of a text with line ends as \\n."""
    import xxhash

    return pd.Series([None if t is None else xxhash.xxh3_128_hexdigest(t.replace("\r\n", "\n").replace("\r", "\n")) for t in text])


def unix_ms(at: Column) -> Column:
    """Milliseconds since 1970, as stamps of files have them."""
    return F.unix_millis(at.cast("timestamp"))


def iso_time(at: Column) -> Column:
    """A time to the second with Z, in the session's zone, which should be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
