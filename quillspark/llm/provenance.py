"""Problem 4: files that nobody of the repository wrote: generated, minified, vendored, or data.

Vendored copies are found by content. Every distinct line of a file is hashed; files with the same lines (headers
and comments aside) are one class. A class that stands in several projects is a shared one, whatever its paths
say. An inverted index of each class's rarest lines then finds edited copies: classes of different projects that meet
there become candidates, at any frequency of the lines, and the exact containment of one's lines in the other decides.
Rules on the composition of a file's tokens (counters in names, literals, white space, notices) judge the files that
the index leaves. Branches of one project are one project.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .codefiles import FILE

COMMENT_HEAD = re.compile(r"(?:\s*(?://|#|--|/\*+|\*|;|<!--|\"\"\"|''')[^\n]*\n?|\s*\n){1,25}")
GENERATED = re.compile(
    r"code generated\b.*do not edit|@generated\b|<auto-?generated|\bauto-?generated\b(?! by (?:the )?caller)|\bautogenerated\b|^\W*generated (?:source|file|code|by|from|automatically|with|on)\b"
    r"|automatically (?:generated|created)|this (?:file|code|module|source) (?:is|was|has been) (?:auto\S* )?generated|machine[- ]generated|generated .{0,60}do not (?:edit|modify|change)|do not (?:edit|modify).{0,40}generated"
    r"|to regenerate this|automatisch (?:erzeugt|generiert|erstellt)|g[ée]n[ée]r[ée]e? automatiquement|generado autom[áa]ticamente|fichero generado|archivo generado",
    re.I | re.M,
)
#: Sentences about generation, not marks of it.
ABOUT = re.compile(r"\b(?:once|formerly|no longer|not|never|used to be)\s+(?:\w+\s+){0,2}generated|\b(?:written|made|kept|maintained) by hand|\bhand-?written|by the caller", re.I)
NOTICE = re.compile(
    r"(?:imported|copied|vendored|taken|bundled) from (?:the )?\S+ (?:project|repository|package|library)|(?:imported|copied|vendored|taken) from https?://|^\W*upstream: \S+ (?:release|version|tag)|\b\d+\.\d+(?:\.\d+)? - \(c\) (?:19|20)\d\d .{1,60}\bcontributors\b|\(c\) (?:19|20)\d\d .{1,60}\band contributors\b.{0,20}licen[cs]e",
    re.I | re.M,
)
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
NUMBER = re.compile(r"(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?)")
COUNTER = re.compile(r"([A-Za-z_]+?_?)(\d{2,6})(?!\d)")
LINE_COMMENT = re.compile(r"^\s*(?://|#|--|\*|/\*)")
INSERT = re.compile(r"(?i)^\s*(?:insert\s+into\b|\()")


def counted(code: str) -> bool:
    """Names of one stem with numbers in sequence make up much of the file."""
    stems: dict[str, set[int]] = {}
    lines = [x for x in code.split("\n") if x.strip()]
    seen = Counter()
    for n, line in enumerate(lines):
        for stem, digits in set(COUNTER.findall(line)):
            if digits[0] == "0" or len(digits) <= 4:
                stems.setdefault(stem, set()).add(int(digits))
                seen[stem] += 1
    for stem, numbers in stems.items():
        if len(numbers) >= 5 and max(numbers) - min(numbers) < 2 * len(numbers) and seen[stem] >= 0.15 * len(lines):
            return True
    return False


#: A text block that is a value.
TEXT_BLOCK = re.compile(r"[=(,\[:]\s*[A-Za-z]?(\"\"\"|\'\'\'|`)([\s\S]*?)\1")
#: What is encoded has no blanks for longer than words and names do.
ENCODED = re.compile(r"\S{40,}")


def blob(code: str) -> bool:
    """Few names about much literal data."""
    solid = len(re.sub(r"\s+", "", code))
    if solid >= 200 and sum(len(x) for m in TEXT_BLOCK.finditer(code) for x in ENCODED.findall(m[2])) > 0.6 * solid:
        return True
    bare = re.sub(r"\"\"\"[\s\S]*?\"\"\"|/\*[\s\S]*?\*/|(?m:^\s*(?://|#|--).*$)", "", code)
    solid = len(re.sub(r"\s+", "", bare))
    if solid < 200:
        return False
    strings = [s for s in STRING.findall(bare)]
    if any(len(s) >= 300 and " " not in s for s in strings) and sum(len(s) for s in strings if len(s) >= 60 and " " not in s) > 0.6 * solid:
        return True
    rest = STRING.sub("", bare)
    numbers = NUMBER.findall(rest)
    return len(numbers) >= 50 and sum(len(n) + 1 for n in numbers) > 0.6 * len(re.sub(r"\s+", "", rest)) or len(strings) >= 100 and sum(len(s) + 1 for s in strings if " " not in s) > 0.85 * solid


def json_data(code: str) -> bool:
    """Records or numbers, as against settings."""
    try:
        v = json.loads(code)
    except (ValueError, RecursionError):
        return len(code) > 1500 and len(NUMBER.findall(code)) * 8 > len(code) * 0.8
    if isinstance(v, dict) and len(v) <= 3:
        lists = [x for x in v.values() if isinstance(x, list)]
        v = max(lists, key=len, default=v)
    if isinstance(v, list):
        if len(v) >= 10 and all(isinstance(x, dict) for x in v):
            return len({tuple(sorted(x)) for x in v}) * 4 <= len(v)
        return len(v) >= 40
    return len(code) > 3000 and len(NUMBER.findall(STRING.sub("", code))) * 8 > 0.5 * len(code)


def sql_data(code: str) -> bool:
    lines = [x for x in code.split("\n") if x.strip() and not LINE_COMMENT.match(x)]
    rows = sum(1 for x in lines if INSERT.match(x) and re.search(r"\d|'", x))
    return rows >= 15 and rows > 0.8 * len(lines)


def minified(code: str) -> bool:
    """Code without the white space that people need."""
    body = re.sub(r"^\s*/\*[\s\S]*?\*/\s*", "", code)
    if len(body) < 200:
        return False
    lines = body.rstrip("\n").split("\n")
    bare = STRING.sub('""', body)
    blanks = len(re.findall(r"\s", bare)) / max(1, len(bare))
    return blanks < 0.1 and (max(map(len, lines)) >= 200 or len(body) / len(lines) >= 80) and len(re.findall(r"[;{}(),=]", bare)) > 0.12 * len(bare)


def composition(code: str, extension: str) -> str | None:
    """generated, minified, data, vendored (by its notice), or None."""
    m = COMMENT_HEAD.match(code + "\n")
    head = m[0] if m else ""
    if any(GENERATED.search(x) and not ABOUT.search(x) for x in head.split("\n")):
        return "generated"
    if NOTICE.search(head):
        return "vendored"
    if extension == "json":
        return "data" if json_data(code) else None
    if extension == "sql":
        return "data" if sql_data(code) else None
    if extension in ("yaml", "yml"):
        return "generated" if len(code) > 400 and counted(re.sub(r":.*", "", code)) and len(set(re.sub(r"\d+", "0", code).split("\n"))) * 6 < code.count("\n") else None
    if extension in ("js", "ts", "css", "mjs", "jsx", "tsx") and minified(code):
        return "minified"
    if blob(code):
        return "data"
    if len(code) > 200 and counted(code):
        return "generated"
    return None


#: The lowest bits of a line's hash hold its length, up to this.
LENGTH = 255


def line_hashes(code: str) -> np.ndarray:
    """Hashes of the distinct lines that say something; comments aside, so that other headers make no difference."""
    lines = {" ".join(x.split()) for x in code.split("\n") if not LINE_COMMENT.match(x)}
    return np.sort(np.array([xxhash.xxh64_intdigest(x) & ~LENGTH | min(len(x), LENGTH) for x in lines if len(x) >= 8], np.uint64).view(np.int64))


def characters(lines: str):
    """The length of all lines of an array of their hashes."""
    return F.expr(f"aggregate({lines}, 0L, (n, x) -> n + (x & {LENGTH}))")


def alike(classes: DataFrame, least: int, contained: float, proof: int, proof_chars: int, few: int, usual: int = 32, hold: int = 1_000) -> DataFrame:
    """(node): classes that have ``contained`` of the smaller one's lines, ``least`` or more, in common with a class of another project.

    The common lines prove a copy if they are ``proof`` or have ``proof_chars`` characters; fewer may be idioms.
    classes: node, p1 (the project), shared (it stands in several), lines. A shared class may pair with any that is not.
    Exact: if the smaller class has t lines in the larger one, one of its n - t + 1 least frequent lines is among them
    (a prefix), so only these are joined with the lines of the others. Lines that no two projects hold come first
    of all and need no join. ``usual`` is the number of classes from which a line counts as frequent: over such lines
    each class is first compared with a few holders, so of a large group of copies nearly all are settled without its
    pairs; the exact join then takes the others. Of a line that more than ``hold`` classes hold, they are salted.
    """
    classes = classes.filter((F.size("lines") >= proof) | (F.size("lines") >= least) & (characters("lines") >= proof_chars))

    def small(df: DataFrame) -> DataFrame:
        """For a join against many rows: sent to all executors if it is small, as counted."""
        df = materialise(df, "index")
        return F.broadcast(df) if df.count() <= few else df

    lines = classes.filter("shared is not null").select("node", "p1", "shared", F.size("lines").alias("n"), F.explode("lines").alias("line"))
    held = lines.groupBy("line").agg(F.count("*").alias("df"), F.min("p1").alias("q1"), F.max("p1").alias("q2"), F.max("shared").alias("any")).filter("df > 1 and (q1 <> q2 or any)").select("line", "df")
    w = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "line"))
    need = F.greatest(F.lit(least), F.ceil(F.col("n") * contained - 1e-9))
    entries = materialise(lines.join(small(held), "line").withColumn("at", place).withColumn("need", need).withColumn("first", F.expr("at <= n - need + 1")), "entries")

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("line", *[c for c in ("_s",) if c in df.columns], *[F.col(c).alias(f"{c}_{s}") for c in ("node", "p1", "shared", "n", "at", "need", "df")])

    eligible = "node_a <> node_b and not (shared_a and shared_b) and (shared_a or shared_b or p1_a <> p1_b)"

    def verified(pairs: DataFrame) -> DataFrame:
        la = classes.select(F.col("node").alias("node_a"), F.col("lines").alias("la"))
        lb = classes.select(F.col("node").alias("node_b"), F.col("lines").alias("lb"))
        good = pairs.select("node_a", "node_b").distinct().join(la, "node_a").join(lb, "node_b").withColumn("same", F.array_intersect("la", "lb"))
        same = F.size("same")
        good = good.filter((same >= contained * F.least(F.size("la"), F.size("lb"))) & (same >= least) & ((same >= proof) | (characters("same") >= proof_chars)))
        return good.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()

    # A few holders of each frequent line, of two projects where there are two.
    hot = entries.filter(F.col("df") > usual)
    whole = F.struct("p1", "n", "node", "shared", "at", "need", "df")
    some = hot.groupBy("line", F.pmod(F.xxhash64("node"), F.lit(4)).alias("_s")).agg(F.min(whole).alias("x"), F.max(whole).alias("y")).select("line", F.explode(F.array("x", "y")).alias("r")).select("line", "r.*")
    settled = materialise(verified(side(hot.filter("first"), "a").join(small(side(some, "b")), "line").filter(eligible)), "settled")

    # All pairs in which one is not settled: the prefix of the smaller against the lines of the larger.
    done = small(settled.select("node", F.lit(True).alias("done")))
    entries = entries.join(done, "node", "left").withColumn("done", F.coalesce("done", "shared"))
    ways = F.ceil(F.col("df") / hold).cast("int")
    salted = entries.withColumn("_s", F.pmod(F.xxhash64("node"), ways).cast("int"))
    copied = entries.filter("not done").withColumn("_s", F.explode(F.sequence(F.lit(0), ways - 1)))
    larger = "(n_b > n_a or n_b = n_a and node_b > node_a) and n_b - at_b + 1 >= need_a"

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return side(a, "a").join(side(b, "b"), ["line", "_s"]).filter(f"{eligible} and {larger}").select("node_a", "node_b")

    pairs = met(copied.filter("first"), salted).unionByName(met(salted.filter("first and done"), copied))
    return settled.unionByName(verified(pairs)).distinct()


def not_handwritten(files: DataFrame, least: int = 6, contained: float = 0.7, proof: int = 12, proof_chars: int = 400, few: int = 200_000) -> DataFrame:
    """FILE and kind (vendored, generated, minified, data) of each file that is not hand-written; one row per file.

    files: FILE, extension, content. ``least`` is the number of lines below which a copy proves nothing; ``contained``
    the share of a file's lines that another project's file must hold; ``proof`` and ``proof_chars`` the number of
    common lines or of their characters that prove a copy, however many classes hold them (fewer may be idioms).
    Empty and nearly empty files are hand-written. No file is left out for skew: copies collapse into classes, and
    no list of a line's files is ever collected.
    """
    project = F.split_part("git_project_identifier", F.lit("#"), F.lit(1))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for code, ext in zip(p["content"], p["extension"], strict=True):
                kind = composition(code or "", ext)
                lines = line_hashes(code or "")
                if len(lines) < least:
                    lines = lines[:0]
                node = int(np.uint64(xxhash.xxh64_intdigest(lines.tobytes())).view(np.int64)) if len(lines) else None
                rows.append((kind, node, lines if len(lines) else None))
            out = pd.DataFrame(rows, columns=["kind", "node", "lines"]).astype({"node": "Int64"})
            for i, c in enumerate([*FILE, "project"]):
                out.insert(i, c, p[c].to_numpy())
            yield out

    spark = files.sparkSession
    f = files.select(*FILE, project.alias("project"), "extension", "content")
    feats = materialise(f.mapInPandas(judge, ", ".join(f"{c} string" for c in FILE) + ", project string, kind string, node long, lines array<long>"), "provenance")
    left = feats.filter("node is not null")
    classes = left.groupBy("node").agg(F.min("project").alias("p1"), F.max("project").alias("p2"), F.any_value("lines").alias("lines"))
    classes = materialise(classes.withColumn("shared", F.col("p1") != F.col("p2")), "classes")
    vendored = classes.filter("shared").select("node").unionByName(alike(classes, least, contained, proof, proof_chars, few)).distinct().withColumn("copied", F.lit(True))
    kind = F.when(F.col("copied"), "vendored").otherwise(F.col("kind"))
    return feats.join(vendored, "node", "left").select(*FILE, kind.alias("kind")).filter("kind is not null")
