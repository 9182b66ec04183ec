"""One consistent form for text that looks the same but differs in its characters.

Method: script-aware repair. Wide, narrow and joined forms, composed and decomposed accents,
kinds of blanks and hyphens, and invisible characters get one spelling. Then each token's
dominant script is taken from the letters that only one script has, or from the text around
where a token has no such letters. In a token that mixes scripts, or that consists of
look-alikes of another script than the text around, the look-alikes are written in the
dominant script if the result is a word of the corpus. Other tokens keep their letters.

The form decides equality. Of two texts that read the same, one that is written in its
dominant script throughout vouches for the other, since its tokens are words of the corpus.

Nulls stay null. Letter case, digits, accents and the number of visible blanks are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.session import durable

#: Rows up to which the table of asked words is broadcast.
BROADCAST_ROWS = 500_000

#: Latin letters and the Cyrillic and Greek letters that look like them.
LATIN, CYRILLIC = "ABCEHIJKMOPSTXYaceijopsxyËÏëïQWqwdh", "АВСЕНІЈКМОРЅТХУасеіјорѕхуЁЇёїԚԜԛԝԁһ"
LATIN_GREEK, GREEK = "ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"

_TO_LATIN = str.maketrans(CYRILLIC + GREEK, LATIN + LATIN_GREEK)
_TO = {"latin": _TO_LATIN, "cyrillic": str.maketrans(LATIN, CYRILLIC), "greek": str.maketrans(LATIN_GREEK, GREEK)}
_SHARED = set(LATIN + CYRILLIC + LATIN_GREEK + GREEK)
_OTHER_SCRIPT = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯ]")
_LATIN_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]")
#: A token: letters of the three scripts with marks, digits and underscores between them.
TOKEN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿͰ-Ͽἀ-῿Ѐ-ԯ][̀-ͯ]*|[0-9])+")
#: The same token for the corpus vocabulary, as a Java pattern.
TOKEN_SQL = r"((?:[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿͰ-Ͽἀ-῿Ѐ-ԯ][̀-ͯ]*|[0-9])+)"
#: Joiners between emoji show; they are held by a private character while the others go.
_JOINED_EMOJI = re.compile("(?<=[\U0001f000-\U0001faff\u2600-\u27bf\ufe0f])\u200d(?=[\U0001f000-\U0001faff\u2600-\u27bf])")
_HELD = "\ue000"


@lru_cache(maxsize=1)
def _spellings() -> dict[int, str | None]:
    """Code point -> its one spelling: wide, narrow and joined forms, blanks, hyphens, invisible characters."""
    out: dict[int, str | None] = {}
    for o in range(0x80, 0x1F000):
        ch = chr(o)
        kind, _, parts = unicodedata.decomposition(ch).partition("> ")
        if kind in ("<wide", "<narrow", "<initial", "<medial", "<final", "<isolated") or (kind == "<compat" and unicodedata.category(ch)[0] == "L" and len(parts.split()) > 1):
            out[o] = unicodedata.normalize("NFKC", ch)
        elif unicodedata.category(ch) == "Zs":
            out[o] = " "
        elif unicodedata.category(ch) == "Cf" or 0xFE00 <= o < 0xFE10 or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            out[o] = None
    out |= {0x9: " ", 0x2010: "-", 0x2011: "-", 0xFE63: "-", 0xFF0D: "-", 0x2212: "-", 0x2028: "\n", 0x2029: "\n"}
    return out


def clean(text: str) -> str:
    """The character-level spelling of a text."""
    if not text.isascii():
        text = _JOINED_EMOJI.sub(_HELD, text).translate(_spellings()).replace(_HELD, "\u200d")
        text = unicodedata.normalize("NFC", text)
    return text.replace("\r\n", "\n").replace("\t", " ") if "\r" in text or "\t" in text else text


def _script(ch: str) -> str:
    o = ord(ch)
    return "greek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "cyrillic" if 0x400 <= o < 0x530 else "latin"


def dominant(token: str) -> str | None:
    """The script of the letters of a token that only one script has; null if none, or if they disagree."""
    found = {_script(c) for c in token if c.isalpha() and c not in _SHARED}
    return found.pop() if len(found) == 1 else None


def context(text: str) -> str:
    """The script most of a text's unshared letters belong to; Latin where there are none."""
    other = [c for c in _OTHER_SCRIPT.findall(text) if c not in _SHARED]
    if not other:
        return "latin"
    greek = sum(_script(c) == "greek" for c in other)
    latin = sum(c not in _SHARED for c in _LATIN_LETTER.findall(text))
    return max(("latin", latin), ("cyrillic", len(other) - greek), ("greek", greek), key=lambda x: x[1])[0]


def spelled(token: str, around: str) -> str:
    """The token with its look-alikes in its dominant script, or in that of the text around."""
    script = dominant(token) or around
    plain = token.translate(_TO_LATIN)
    return plain if script == "latin" else plain.translate(_TO[script])


def _doubtful(token: str, around: str) -> bool:
    """Whether a token mixes scripts, or has only look-alikes, of another script than the text around."""
    scripts = {_script(c) for c in token if c.isalpha()}
    return len(scripts) > 1 or (len(scripts) == 1 and around not in scripts and all(c in _SHARED for c in token if c.isalpha()))


def asks(text: str) -> list[str]:
    """Spellings of a clean text's doubtful tokens that the vocabulary has to confirm."""
    if not _OTHER_SCRIPT.search(text):
        return []
    around = context(text)
    return sorted({spelled(t, around) for t in TOKEN.findall(text) if _doubtful(t, around)})


def repaired(text: str, known: set[str]) -> str:
    """A clean text with its doubtful tokens spelled in their dominant script where that is a known word."""
    if not known or not _OTHER_SCRIPT.search(text):
        return text
    around = context(text)

    def form(m: re.Match) -> str:
        t = m.group()
        if not _doubtful(t, around):
            return t
        new = spelled(t, around)
        return new if new in known else t

    return TOKEN.sub(form, text)


def is_plain(text: Column) -> Column:
    """Whether a text is printable ASCII and line ends only: its own form and key."""
    return text.rlike(r"^[ -~\n]*\z")


def _keyed(rows: DataFrame, group: list[str], rec: str, text: str) -> tuple[DataFrame, list[str]]:
    """(g0.., rec, raw, same, odd) of the rows whose text is not plain, and of the plain ones with the key of such a row.

    In a pair that reads the same at least one text is not plain, so only keys of these are
    looked for among the others. Texts travel as digests: ``raw`` of the text as stored,
    ``same`` of its form. Rows with a null text or record are left out; repeated rows count once.
    """
    held = rows.where(F.col(text).isNotNull() & F.col(rec).isNotNull()).select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(rec).alias("rec"), F.col(text).alias("text"))
    on = [f"g{i}" for i in range(len(group))]
    odd = held.where(~is_plain(F.col("text"))).select(*on, "rec", "text", F.sha2("text", 256).alias("raw")).distinct()
    forms = consistent_form(odd.select("raw", "text").distinct(), ["raw"], "text", held.where(is_plain(F.col("text"))).select("text"))
    keys = durable(odd.select(*on, "rec", "raw").join(forms.select("raw", F.sha2("form", 256).alias("same")), "raw").select(*on, "rec", "raw", "same", F.lit(True).alias("odd")), "keys")
    plain = (
        held.where(is_plain(F.col("text")))
        .select(*on, "rec", F.sha2("text", 256).alias("raw"))
        .withColumn("same", F.col("raw"))
        .join(keys.select(*on, "same").distinct(), [*on, "same"], "left_semi")
        .select(*on, "rec", "raw", "same", F.lit(False).alias("odd"))
        .distinct()
    )
    return keys.unionByName(plain), on


def same_pairs(rows: DataFrame, group: list[str], rec: str, text: str) -> DataFrame:
    """(rec_a, rec_b) of rows of a group whose texts differ as stored but read the same, rec_a < rec_b.

    Every pair is a row; where groups of copies are large, ``same_classes`` holds the same in
    one row per record.
    """
    keys, on = _keyed(rows, group, rec, text)
    left = keys.where("odd").select(*on, "same", F.col("rec").alias("a"), F.col("raw").alias("raw_a"))
    right = keys.select(*on, "same", F.col("rec").alias("b"), F.col("raw").alias("raw_b"), "odd")
    met = left.join(right, [*on, "same"]).where((F.col("raw_a") != F.col("raw_b")) & (F.col("a") != F.col("b")) & (~F.col("odd") | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b"))


def same_classes(rows: DataFrame, group: list[str], rec: str, text: str) -> DataFrame:
    """(rec, class_id, records, spellings, links): one row per record and stored text of a class with several spellings.

    ``class_id`` is the least record of the class, ``links`` the records of the class with
    another spelling. Counts are summed before they are shuffled, and a class's figures join
    back by key, so a class of any size never gathers in one task.
    """
    keys, on = _keyed(rows, group, rec, text)
    spelled_as = keys.groupBy(*on, "same", "raw").agg(F.count("*").alias("copies"), F.min("rec").alias("first"))
    classes = spelled_as.groupBy(*on, "same").agg(F.sum("copies").alias("records"), F.count("*").alias("spellings"), F.min("first").alias("class_id")).where("spellings > 1")
    met = keys.join(spelled_as.drop("first"), [*on, "same", "raw"]).join(classes, [*on, "same"])
    return met.select(F.col("rec"), "class_id", "records", "spellings", (F.col("records") - F.col("copies")).alias("links"))


def confirmed(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The words of ``wanted`` (word) that are tokens of ``texts`` (text).

    As many words as ``BROADCAST_ROWS`` go to the tasks that read the texts, which then send
    only hits; more are met by a shuffle of the texts' tokens.
    """
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN_SQL), F.lit(1))).alias("word"))
    if wanted.count() <= BROADCAST_ROWS:
        return words.join(F.broadcast(wanted), "word", "left_semi").distinct()
    return wanted.join(words.distinct(), "word", "left_semi")


def consistent_form(texts: DataFrame, key: list[str], text: str, further: DataFrame | None = None) -> DataFrame:
    """``key`` columns with ``form``: equal where texts read the same.

    ``key`` must tell rows apart. The vocabulary is every token of all the texts, and of those
    of ``further`` (text). Texts within ASCII pass on the JVM side, and only texts that ask
    for words are joined with the answers.
    """
    types = {c: texts.schema[c].dataType.simpleString() for c in key}
    names = ", ".join(f"`{c}` {t}" for c, t in types.items())

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [clean(t) for t in batch["text"]]
            yield batch.assign(text=done, asks=[asks(t) for t in done])

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[key].assign(form=[repaired(t, set(k)) for t, k in zip(batch["text"], batch["known"])])

    given = texts.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("text"))
    plain = is_plain(F.col("text"))
    odd = given.where(~plain).mapInPandas(first, f"{names}, text string, asks array<string>")
    odd = durable(odd, "spelled")
    wanted = durable(odd.select(F.explode("asks").alias("word")).distinct(), "asked")
    read = given.where(plain).select("text").unionByName(odd.select("text"))
    known = confirmed(wanted, read if further is None else read.unionByName(further))
    asking = odd.where(F.size("asks") > 0)
    answers = asking.select(*key, F.explode("asks").alias("word")).join(known, "word").groupBy(*key).agg(F.collect_set("word").alias("known"))
    mended = asking.join(answers, key).select(*key, "text", "known").mapInPandas(last, f"{names}, form string")
    silent = asking.join(answers.select(*key), key, "left_anti")
    rest = given.where(plain).select(*key, "text").unionByName(odd.where(F.size("asks") == 0).select(*key, "text")).unionByName(silent.select(*key, "text"))
    return rest.select(*key, F.col("text").alias("form")).unionByName(mended)
