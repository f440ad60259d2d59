"""Problem 5: source files that nobody wrote by hand for their repository."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm import lexers
from depgraph.sources.shared import kept

#: Tokens in a fingerprint, and fingerprints from which winnowing keeps the least. Any copied run of K + W - 1 tokens shares a fingerprint.
K, W = 24, 12
#: A copy: at least this share of a file's fingerprints occurs in at least so many repositories.
COPY_SHARE, COPY_REPOS = 0.4, 3
#: A fingerprint that holds at least one of so many fingerprints of the corpus is hot; there are at most so many.
HOT = 10_000

#: How tools mark their output, in the comments at a file's head or end. A mark says it of the file itself, so it begins a sentence.
_BEGIN = r"(?:^|[.;:!]\s|--\s|—\s|>)[\s/*#<!\-\"'=;]*(?:(?:this|the) (?:file|code|module|source|class|script) (?:is|was|has been|contains) |this is )?"
_GENERATED = re.compile(
    _BEGIN + r"(?:@generated\b|auto-?generated>|(?:code |file )?(?:auto-?|automatically |machine[- ])(?:generated|written|produced)\b(?! (?:method|function|constructor|class)? ?stub)|code generated\b|generated (?:from|by|using|with|on|at|automatically)\b|produced by \w+ v?\d|(?:please )?do not (?:edit|modify)\b|not (?:to )?be (?:edited|modified) by hand\b|(?:your |any |all )?changes (?:to this file |made here )?(?:will be|are) (?:lost|overwritten)\b|edit the (?:template|source|schema) instead\b)",
    re.I,
)
_GENERATED_END = re.compile(r"\bend of (?:the )?(?:automatically |auto-?|machine-)generated\b", re.I)
_GENERATED_NAME = re.compile(r"(?:_pb2?(?:_grpc)?\.\w+|\.pb(?:-c|\.gw)?\.\w+|(?:^|/)zz_generated[._][^/]*|OuterClass\w*\.java|\w(?:Grpc|Generated)\.java|[._-]generated\.\w+|\.(?:gen|g|designer)\.\w+)$", re.I)
#: Folders of third-party code. Those of the second pattern need a folder of the package below them.
_VENDOR_DIR = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|godeps|_workspace|pods|carthage|third[_-]?party|3rd[_-]?party|thirdparty)/", re.I)
_VENDOR_PACKAGE = re.compile(r"(?:^|/)(?:vendor|vendors|vendored|externals?|plugins|extern|deps)/(?:[\w.@-]+)/", re.I)
_THIRD_PARTY = re.compile(r"(?:^|[\s*/#])(?:@license\b|@copyright\b|@preserve\b)|\bupstream at\b|\breleased under (?:the )?(?:\w+[- ])?(?:\w+ )?licen[cs]e\b|\bcopyright (?:\(c\)|©)?\s*\d{4}.{0,12}\bthe \w[\w.-]* (?:authors|contributors|project|developers|team)\b|^\W*/?\*!.*\bv?\d+\.\d+", re.I | re.M)
_CHECKOUT = re.compile(r"(?:^|/)(?:mirrors?|upstream|third[_-]?party|3rd[_-]?party|external|vendor|vendored|forks?)/[^/]+(?:/|$)", re.I)
_BLOB = re.compile(r"[A-Za-z0-9+/=]{40,}")
_HEAD = re.compile(r"\s*(?:<\?php\b)?\s*(?:<\?xml[^>]*>\s*)?((?:(?:/\*[\s\S]*?\*/|//[^\n]*|\#(?!\s*(?:include|define|if|ifdef|ifndef|pragma)\b)[^\n]*|\"\"\"[\s\S]*?\"\"\"|<!--[\s\S]*?-->|=begin[\s\S]*?=end)\s*)*)")
_LAST = re.compile(r"(?:/\*[^*]*(?:\*(?!/)[^*]*)*\*/|(?://|\#)[^\n]*|=begin(?:(?!=begin)[\s\S])*=end|\?>)\s*$")


def checkout(path: str | None) -> bool:
    """Whether a repository at this path is itself a checkout of third-party code."""
    return bool(path) and bool(_CHECKOUT.search(path))


def vendored_path(path: str | None) -> bool:
    p = path or ""
    return bool(_VENDOR_DIR.search(p) or _VENDOR_PACKAGE.search(p))


def comment_marks(text: str) -> tuple[bool, bool]:
    """(marked as generated, marked as third-party) by the comments at the head or the end of a text."""
    head = _HEAD.match(text)[1] if text else ""
    lines = [x for x in head.split("\n") if x.strip()]
    generated = any(map(_GENERATED.search, lines))
    if not generated:
        m = _LAST.search(text[-400:])
        generated = bool(m and _GENERATED_END.search(m[0]))
    return generated, bool(_THIRD_PARTY.search(head))


def shape(text: str, spelled: list[str]) -> tuple[bool, bool]:
    """(minified or packed, data saved as code) by lengths of lines and kinds of tokens."""
    n = len(text)
    lines = text.count("\n") + 1
    names = literals = 0
    for t in spelled:
        c = t[:1]
        if c.isdigit() or c in "\"'`" or c == "." and len(t) > 1 and t[1].isdigit() or t in ("true", "false", "null", "None", "True", "False", "nil"):
            literals += 1
        elif c.isalpha() or c in "_$":
            names += 1
    data = literals >= 40 and names <= 0.04 * literals + 6 or n >= 200 and sum(map(len, _BLOB.findall(text))) >= 0.6 * n
    longest = max(map(len, text.split("\n")))
    blanks = sum(map(text.count, " \t\n")) / max(n, 1)
    minified = not data and names >= 20 and n >= 300 and (n / lines >= 150 and blanks < 0.12 or longest >= 0.8 * n and longest >= 300 and blanks < 0.12)
    return minified, data


def winnow(spelled: list[str], k: int = K, w: int = W) -> np.ndarray:
    """Distinct winnowed fingerprints (int64) of a token stream: in every window of w k-grams the least hash is kept."""
    if len(spelled) < k:
        return np.zeros(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in spelled), np.uint64, len(spelled))
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            grams = grams * base + h[i : len(h) - k + 1 + i]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
    if len(grams) <= w:
        return np.array([grams.min()]).view(np.int64)
    least = np.lib.stride_tricks.sliding_window_view(grams, w).min(axis=1)
    return np.unique(least).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
    for b in batches:
        rows = []
        for language, path, text in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            dialects = lexers.of(language, path)
            reason, marks, forms, prints = "", (False, False), (False, False), np.zeros(0, np.int64)
            if text and not text.isspace():
                spelled = [t for t in (dialects[0].spellings(text) if dialects else re.findall(r"\w+|[^\w\s]", text)) if t and not t.isspace() and t[0] not in "\n\r"]
                marks, forms, prints = comment_marks(text), shape(text, spelled), winnow(spelled)
            reason = ",".join(r for r, on in (("generated", marks[0] or bool(text) and bool(_GENERATED_NAME.search(path or ""))), ("vendored", vendored_path(path) and (text is None or bool(text.strip())) or marks[1]), ("minified", forms[0]), ("data", forms[1])) if on)
            rows.append((reason, *marks, *forms, prints))
        cols = list(zip(*rows)) or [()] * 6
        out = [pa.array(c, t) for c, t in zip(cols, kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out[0], out[5]], ["file_id", "repo_id", "reason", "prints"])


def features(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, reason, prints): what a file's own text and path say, and its winnowed fingerprints."""
    given = files.select("file_id", "repo_id", "language", "file_path", "content").where("file_id IS NOT NULL")
    return given.mapInArrow(_features, f"file_id {dict(given.dtypes)['file_id']}, repo_id string, reason string, prints array<bigint>")


def not_handwritten(files: DataFrame, repos: DataFrame, share: float = COPY_SHARE, least_repos: int = COPY_REPOS) -> DataFrame:
    """(file_id, repo_id, reasons) of the files that nobody wrote by hand, reasons a comma-separated list of
    generated, minified, data, vendored (path or licence head), copied (fingerprints) and checkout.

    A copy is a file of whose winnowed fingerprints at least ``share`` occur in ``least_repos`` repositories
    or more. Of files delivered twice the reasons are put together; null and empty contents have no fingerprints and are cases
    only by the path of their repository, or, if unreadable, by their own. Repositories are matched by id; a
    file without repository row can't be a checkout's. Empty tables give no rows. Fingerprints that hold much
    of the corpus are broadcast (at most HOT of them), so no task gets a hot one's files.
    """
    f = kept(features(files), "origin")  # lexed once, read for the counts, the join and the files
    prints = f.where(F.size("prints") > 0).select("file_id", "repo_id", F.explode("prints").alias("print"))
    spread = prints.groupBy("print", "repo_id").agg(F.count("*").alias("n")).groupBy("print").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n")).where(F.col("n_repos") >= least_repos)
    spread = kept(spread.select("print", "n"), "origin-spread")
    total = f.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0]
    hot = F.broadcast(spread.where(F.col("n") * HOT >= total).select("print", F.lit(True).alias("hot")))  # at most HOT rows
    rare = spread.where(F.col("n") * HOT < total).select(F.col("print").alias("key"), F.lit(True).alias("rare"))
    # what is hot is known already and needs no partner; its rows go where their files' hashes lead
    marked = prints.select("file_id", "print").join(hot, "print", "left").withColumn("at", F.when(F.col("hot"), F.xxhash64("file_id", "print")).otherwise(F.col("print")))
    found = marked.join(rare, F.col("at") == F.col("key"), "left").where("hot OR rare")
    shared = found.groupBy("file_id").agg(F.count_distinct("print").alias("n_shared"))
    reasons = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("reason", ","))))), ",")  # of a handful of words
    own = f.groupBy("file_id").agg(F.max("repo_id").alias("repo_id"), reasons.alias("reason"), F.max(F.size("prints")).alias("n_prints"))
    places = repos.where("id IS NOT NULL").select(F.col("id").alias("repo_id"), F.col("path").rlike("(?i)" + _CHECKOUT.pattern).alias("checkout")).groupBy("repo_id").agg(F.max("checkout").alias("checkout"))
    joined = own.join(shared, "file_id", "left").join(places, "repo_id", "left")
    copied = (F.col("n_shared") >= share * F.col("n_prints")) & (F.col("n_shared") >= 1)
    reasons = F.concat_ws(",", F.nullif(F.regexp_replace("reason", "^,", ""), F.lit("")), F.when(copied, "copied"), F.when(F.col("checkout"), "checkout"))
    return joined.select("file_id", "repo_id", reasons.alias("reasons")).where("reasons <> ''")
