"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WORD = re.compile(r"[^ \t-\r]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
#: Marks that end a sentence.
TERMINAL = (".", "!", "?", "…", ":", ";", '"', "'", ")", "»", "”", "。", "！", "？", "’", "]", "」", "』", "）", "．", "｡", "।", "॥", "؟", "۔", "։", "።", "။", "།", "។")
#: Thai and Lao write sentences without end marks.
UNMARKED = re.compile(r"[\u0e00-\u0eff]")
#: A line of so many words has end punctuation, at its end or after one in so many of its words (a paragraph that is cut off).
PUNCTUATED_WORDS, WORDS_AN_END = 8, 30
#: Phrases of navigation and boilerplate lines in English, French, German and Spanish, lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "javascript", "lorem ipsum",
    "click here", "read more", "sign in", "log in", "subscribe", "powered by", "copyright", "back to top", "share this",
    "tous droits réservés", "politique de confidentialité", "politique de cookies", "conditions d'utilisation", "mentions légales", "cliquez ici", "lire la suite", "se connecter", "s'abonner",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "nutzungsbedingungen", "impressum", "hier klicken", "weiterlesen", "anmelden", "abonnieren", "nach oben",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "condiciones de uso", "términos de uso", "aviso legal", "haga clic aquí", "leer más", "iniciar sesión", "suscribirse",
)
#: A phrase begins a word; one of several words ends one too ("sign in", not "design in" or "sign instead").
PHRASE = re.compile("|".join(rf"\b{x}\b" if " " in x else rf"\b{x}" for x in BOILERPLATE))
#: A line is boilerplate with at most so many words for each word of a phrase.
WORDS_A_PHRASE_WORD = 15
#: A document is rejected if removed lines hold more than this share of its characters in words.
MAX_LOST = 0.5
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_lines long, lost_chars long, cleaned string"


def repeated_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of `window` words found twice or more, exact: windows are compared by ranks, doubled in length."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[str, int] = {}
    rank = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    length = 1
    while length < window:
        step = min(length, window - length)
        rank = rank[: len(rank) - step] * np.int64(len(words) + 1) + rank[step:]
        _, rank, counts = np.unique(rank, return_inverse=True, return_counts=True)
        length += step
    twice = np.flatnonzero(counts[rank] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def line_fails(words: list[str], line: str) -> bool:
    """Navigation (two or more separators), symbol noise, shouting, one word over and over, no end punctuation, or boilerplate phrases in a line that is short for them."""
    n = len(words)
    if line.count(" | ") >= 2 or line.count(" > ") >= 2 or line.count("»") > 2:
        return True
    if len(SYMBOL.findall(line)) * 10 > 3 * n and n >= 3:
        return True
    letters = sum(w.isupper() for w in words)
    if n >= 3 and letters * 10 > 7 * n:
        return True
    if n >= 8 and len(set(words)) * 5 <= n:
        return True
    if n >= PUNCTUATED_WORDS and not words[-1].endswith(TERMINAL) and not UNMARKED.search(line) and sum(w.endswith(TERMINAL) for w in words) * WORDS_AN_END < n:
        return True
    low = " ".join(words).lower()
    return n <= WORDS_A_PHRASE_WORD * sum(len(x.split()) for x in PHRASE.findall(low))


def clean(text: str, max_lost: float = MAX_LOST) -> tuple:
    """Counts, verdicts and the text without failing lines, of one text."""
    words, seen = WORD.findall(text), set()
    chars = sum(map(len, words))
    dup = lost = 0
    kept = []
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        dup += again
        if again or line_fails(own, line):
            lost += sum(map(len, own))
        else:
            kept.append(line)
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    good = not failed and lost <= max_lost * chars
    return len(words), chars, len(SYMBOL.findall(text)), dup, repeats, failed, good, len(kept), lost, "\n".join(kept)


def _run(max_lost: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_lines", "lost_chars", "cleaned"]
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
        for batch in batches:
            rows = [clean(x or "", max_lost) for x in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return run


def quality_rules(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """A row for each row of docs: counts, base_failed, kept, and the cleaned text.

    A null or empty text has no words and fails the base rule. A line equal to an earlier one is removed once it repeats.
    A share of lost characters equal to max_lost is kept. Repeated rows get a row each; a long text is one row; other columns
    of docs are not read; an empty table gives no rows. One pass, no exchange.
    """
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_run(max_lost), RESULT)
