"""Finding and reading files: directories, path lists, git repositories, logs, PDF text."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..operators.filters import glob_regex

# Extensions by type of corpus, and what is left out.
EXTENSIONS = {
    "pdf": ["pdf"],
    "markdown": ["md", "markdown", "mdown", "mkd", "mkdn"],
    "code": [
        "py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "rb", "cpp", "c", "h", "hpp", "cs", "swift", "kt", "scala", "php", "pl", "sh", "bash",
        "zsh", "ps1", "lua", "r", "sql", "graphql", "proto", "thrift", "yaml", "yml", "json", "xml", "html", "css", "scss", "less", "vue",
        "svelte",
    ],
}
EXCLUDED_NAMES = [
    "*.min.js", "*.min.css", "*-min.js", "*-min.css", "*-search-index.js", "*-search-index.json", "search-index.js", "search-index.json",
    "*.bundle.js", "*.bundle.css", "*-bundle.js", "*-bundle.css", "*.map", "*.js.map", "*.css.map", "*_generated.go", "*.generated.go",
    "zz_generated_*.go", "zz_generated.*.go", "*_generated.py", "*.pb.go", "*_pb2.py", "*_pb2_grpc.py", "*.gen.go", "*.gen.ts", "generated.ts",
    "generated.js",
]
EXCLUDED_FOLDERS = ["javadoc", "jsdoc", "apidocs", "node_modules", "vendor", "dist", "build"]
LONGEST_LINE = 5000


def kept(path: Column, base: str, names: list[str] = EXCLUDED_NAMES, folders: list[str] = EXCLUDED_FOLDERS, folder_prefixes: tuple[str, ...] = ("_",)) -> Column:
    """Whether a path passes the exclusion by folder names, folder prefixes below the base, and file names."""
    parts = F.split(paths.detach(path, F.lit(base)), "/")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))
    for p in folder_prefixes:
        bad = bad | F.arrays_overlap(F.transform(inner, lambda x: F.substring(x, 1, len(p))), F.array(F.lit(p)))
    for n in names:
        bad = bad | paths.filename(path).rlike(glob_regex(n))
    return ~bad


def longest_line(text: Column, chars: int = 65_536) -> Column:
    return F.array_max(F.transform(F.split(F.substring(text, 1, chars), "\n"), F.length))


@F.pandas_udf(T.BooleanType())
def is_text(head: pd.Series) -> pd.Series:
    """Of a file's first 8 KiB: not empty, no NUL, fewer than a tenth control bytes."""

    def one(b: bytes) -> bool:
        if not b or b"\0" in b:
            return False
        return sum(c < 32 and c not in (9, 10, 12, 13) for c in b) < 0.1 * len(b)

    return head.map(one)


def discover(spark: SparkSession, folder: str, kind: str, extensions: list[str] | None = None, contents: bool = True, tracked: DataFrame | None = None) -> DataFrame:
    """(file_path, mtime, size, content) of a corpus type's files below a folder.

    Left out are, but for PDF, files that are no text, and scripts of one endless line. ``tracked`` (file_path), as of
    ``git_files``, limits the files to those under version control.
    """
    ext = extensions or EXTENSIONS[kind]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ext) + "}").load(folder)
    df = df.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    df = df.filter(kept(F.col("file_path"), folder))
    if tracked is not None:
        df = df.join(tracked.select("file_path").distinct(), "file_path", "left_semi")
    if kind != "pdf":
        df = df.filter(is_text(F.substring("content", 1, 8192)))
    if kind == "code":
        script = paths.extension(F.col("file_path")).isin("js", "css", "jsx", "ts")
        df = df.filter(~script | (longest_line(F.col("content").cast("string")) <= LONGEST_LINE))
    return df if contents else df.drop("content")


def ordered(files: DataFrame, by: str = "path") -> DataFrame:
    """By path, newest or oldest first; files without time come last, ties by path."""
    return {"path": files.orderBy("file_path"), "newest": files.orderBy(F.col("mtime").desc_nulls_last(), "file_path"), "oldest": files.orderBy(F.col("mtime").asc_nulls_last(), "file_path")}[by]


def path_list(spark: SparkSession, at: str, base: str) -> DataFrame:
    """Paths of a list file: blank lines and comments left out, relative ones below the base."""
    line = F.trim(F.col("value"))
    return spark.read.text(at).select(line.alias("p")).filter((F.col("p") != "") & ~F.col("p").startswith("#")).select(paths.attach(F.col("p"), F.lit(base)).alias("file_path"))


def git_projects(root: str, depth: int | None = None) -> list[str]:
    """Folders that hold a .git, at most ``depth`` levels below the root."""
    base, out = Path(root), []
    for d, subs, _ in os.walk(base):
        level = len(Path(d).relative_to(base).parts)
        if ".git" in subs:
            out.append(d)
        subs[:] = [] if depth is not None and level >= depth else sorted(s for s in subs if s != ".git")
    return sorted(out)


def _git(root: str, *args: str) -> str | None:
    r = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=False)
    return r.stdout.strip() if r.returncode == 0 and r.stdout.strip() else None


def git_branch(root: str) -> str:
    """The branch, else (tag) with T, else the detached commit."""
    if b := _git(root, "symbolic-ref", "--short", "-q", "HEAD"):
        return b
    if t := _git(root, "describe", "--tags", "--exact-match"):
        return f"({t})T"
    return f"(detached-{(_git(root, 'rev-parse', 'HEAD') or '')[:12]})"


def git_metadata(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Name, branch, commit, remote and identifiers of repositories on the driver's disk."""
    rows = []
    for r in roots:
        names = (_git(r, "remote") or "").split()
        remote = next((n for n in ("origin", "upstream") if n in names), names[0] if names else None)
        rows.append((r, git_branch(r), _git(r, "rev-parse", "HEAD"), _git(r, "remote", "get-url", remote) if remote else None))
    df = spark.createDataFrame(rows, "git_project_root string, git_branch string, git_commit_hash string, git_remote_url string")
    df = df.withColumn("git_remote_url", paths.strip_credentials(F.col("git_remote_url")))
    df = df.withColumn("git_project_name", paths.project_of(F.col("git_remote_url"), F.col("git_project_root")))
    df = df.withColumn("git_project_identifier", F.concat("git_project_name", F.lit("#"), "git_branch"))
    return df.withColumn("git_version_identifier", paths.version_id(F.col("git_project_name"), F.col("git_branch"), F.col("git_commit_hash")))


def git_files(root: str, extensions: list[str] | None = None) -> list[str]:
    """Tracked files, as absolute paths."""
    names = (_git(root, "ls-files", "-z") or "").split("\0")
    return [os.path.join(root, n) for n in names if n and (not extensions or n.rsplit(".", 1)[-1] in extensions)]


def pdf_text(files: DataFrame) -> DataFrame:
    """(file_path, page_number, text, error) of PDF contents, by whichever PDF library the workers have.

    Without one, each file gives one row with an error and no text. A broken file never fails the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import fitz  # an optional dependency
        except ImportError:
            fitz = None
        for p in batches:
            rows = []
            for path, data in zip(p["file_path"], p["content"], strict=True):
                if fitz is None:
                    rows.append((path, None, None, "no PDF library"))
                    continue
                try:
                    with fitz.open(stream=data, filetype="pdf") as doc:
                        rows += [(path, i + 1, page.get_text(), None) for i, page in enumerate(doc)]
                except Exception as e:  # noqa: BLE001 - the file is reported, not the job
                    rows.append((path, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["file_path", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    return files.select("file_path", "content").mapInPandas(run, "file_path string, page_number int, text string, error string")


def ocr_text(images: DataFrame, language: str = "eng") -> DataFrame:
    """(file_path, page_number, text, confidence, error) of page images, by an OCR engine if the workers have one.

    Words come in reading order; those of low confidence are kept, and the page's mean is reported.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import io

            import pytesseract  # an optional dependency
            from PIL import Image
        except ImportError:
            pytesseract = None
        for p in batches:
            rows = []
            for path, page, data in zip(p["file_path"], p["page_number"], p["content"], strict=True):
                if pytesseract is None:
                    rows.append((path, page, None, None, "no OCR engine"))
                    continue
                try:
                    d = pytesseract.image_to_data(Image.open(io.BytesIO(data)).convert("L"), lang=language, output_type=pytesseract.Output.DICT)
                    seen = sorted((b, r, ln, w, t, float(c)) for b, r, ln, w, t, c in zip(d["block_num"], d["par_num"], d["line_num"], d["word_num"], d["text"], d["conf"], strict=True) if str(t).strip())
                    ok = [c for *_, c in seen if c >= 0]
                    rows.append((path, page, " ".join(t for *_, t, _ in seen), sum(ok) / len(ok) if ok else None, None))
                except Exception as e:  # noqa: BLE001 - the page is reported, not the job
                    rows.append((path, page, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["file_path", "page_number", "text", "confidence", "error"])

    return images.select("file_path", "page_number", "content").mapInPandas(run, "file_path string, page_number int, text string, confidence double, error string")


LOG_SCHEMA = "timestamp string, command string, subcommand string, query string, result_count int, duration_ms long, context string, project string, cwd string, error string"


def log_tail(spark: SparkSession, at: str, n: int = 50) -> DataFrame:
    """The last entries over all rotated files."""
    return spark.read.schema(LOG_SCHEMA).json(at).orderBy(F.col("timestamp").desc()).limit(n)


def log_append(entries: DataFrame, to: str) -> None:
    entries.write.mode("append").json(to)


def git_changed(root: str, since: str, until: str = "HEAD") -> list[tuple[str, str, str | None]]:
    """(status, path, old path of a rename) of the files that changed between two commits: A, M, D or R."""
    out, parts = [], (_git(root, "diff", "--name-status", "-M", "-z", since, until) or "").split("\0")
    it = iter(parts)
    for status in it:
        if not status:
            continue
        path = next(it)
        if status[0] in "RC":
            out.append((status[0], os.path.join(root, next(it)), os.path.join(root, path)))
        else:
            out.append((status[0], os.path.join(root, path), None))
    return out


def git_clean(root: str) -> bool:
    """Whether no tracked file differs from the commit."""
    r = subprocess.run(["git", "-C", root, "status", "--porcelain", "--untracked-files=no"], capture_output=True, text=True, timeout=60, check=False)
    return r.returncode == 0 and not r.stdout.strip()
