"""Pieces of text that a byte-level tokenizer merges separately."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LAST = 0x110000


def _points(text: str) -> frozenset[int]:
    return frozenset(map(ord, text))


def _all_characters() -> str:
    return "".join(chr(c) for c in range(LAST) if not 0xD800 <= c < 0xE000)


def tiktoken_class(name: str) -> frozenset[int]:
    """Code points that tiktoken takes for ``name``, such as ``\\p{L}``."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    matcher = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
    # what the expression does not match has no tokens
    return _points(bytes(matcher.encode_ordinary(_all_characters())).decode())


def tokenizers_class(name: str) -> frozenset[int]:
    """Code points that the tokenizers library takes for ``name``."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(name), "removed")
    text = _all_characters()
    return _points(text) - _points("".join(piece for piece, _ in split.pre_tokenize_str(text)))


@lru_cache(maxsize=2)
def _java_classes(spark: SparkSession) -> tuple[frozenset[int], frozenset[int]]:
    """Letters and numbers as the JVM knows them, which is an older Unicode."""
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    points = spark.range(LAST).where("id < 55296 OR id >= 57344").select("id", char.alias("c"))
    found = points.select("id", F.col("c").rlike(r"^\p{L}$").alias("l"), F.col("c").rlike(r"^\p{N}$").alias("n")).where("l OR n")
    rows = found.collect()
    return frozenset(r.id for r in rows if r.l), frozenset(r.id for r in rows if r.n)


def _ranges(points) -> str:
    """Code points as the inside of a Java character class."""
    runs: list[list[int]] = []
    for p in sorted(points):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


def _late(points) -> str:
    """The same for many points that few texts have: one look at where they
    begin spares the others a look at each range."""
    return rf"[[\x{{{min(points):x}}}-\x{{10ffff}}]&&[{_ranges(points)}]]" if points else ""


@lru_cache(maxsize=8)
def java_pattern(spark: SparkSession, pattern: str, library: Callable[[str], frozenset[int]] = tiktoken_class) -> str:
    r"""``pattern`` for the JVM, with the library's white space, letters and
    numbers. It may name them as \s, \S, \p{L}, \p{N} and [^\s\p{L}\p{N}]."""
    white = _ranges(library(r"\s"))
    inside, extra = {}, {}
    for name, java in zip((r"\p{L}", r"\p{N}"), _java_classes(spark)):
        own = library(name)
        inside[name] = name + _late(own - java)
        extra[name] = _ranges(java - own)
    classes = {n: f"[{inside[n]}]" if not extra[n] else f"[{inside[n]}&&[^{extra[n]}]]" for n in inside}
    if any(extra.values()):
        other = "(?:" + "".join(f"(?!{c})" for c in classes.values()) + f"[^{white}])"
    else:
        other = f"[^{white}{''.join(inside.values())}]"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", "\0")
    for name, own in classes.items():
        out = out.replace(f"[{name}]", own).replace(name, own)
    out = out.replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")
    return out.replace("\0", other)


def pretokens(text: Column, java: str) -> Column:
    """The pieces of ``text`` in order, as an array; ``java`` is a pattern for
    the JVM (``java_pattern``)."""
    return F.regexp_extract_all(text, F.lit(java), 0)


def ragged(starts, lengths):
    """Places of the elements of many runs, one run after the other (numpy)."""
    import numpy as np

    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
