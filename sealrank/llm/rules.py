"""Line-first quality rules.

Every line with a word is judged alone: it must hold the end of a sentence (punctuation), must
not be a row of links (navigation), nor symbol noise, nor shouting, nor a stock phrase
(boilerplate; only lines of at most ``PHRASE_WORDS`` words, for a longer line is text that mentions
it). Failing lines are removed. A document is rejected when the failing lines hold
more than ``max_loss`` percent of its words, or when it fails the two base rules: fewer than 10
words, or over a fifth of its words inside repeated 5-word windows.

Each text is judged inside the batch that reads it, so there is no shuffle and nothing grows with
the corpus.

Defined cases: a null text has no words and fails; lines without a word are neither judged nor
counted as copies; a null doc_id and repeated rows are carried through; an empty table gives no
rows; other columns are ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sealrank.llm.words import chunks, covered, gram_hashes, hash_words, mix, slices, texts_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS_PERCENT = 50

# Ends of other scripts' sentences need no space after them.
SENTENCE_END = re.compile(r"""[.!?…]["'”’»)\]]*(?=\s|$)|[。！？｡．।॥؟۔။።፧։។៕]""")
PHRASE_WORDS = 30
SEPARATORS = frozenset("| > < » « • · / -".split())
SYMBOLS = frozenset("#*$%&|<>")
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
    "enable javascript", "click here", "sign up for our newsletter", "lorem ipsum", "powered by wordpress",
    "tous droits réservés", "conditions d'utilisation", "conditions générales d'utilisation", "politique de confidentialité", "accepter les cookies",
    "activer javascript", "cliquez ici", "inscrivez-vous à notre newsletter", "mentions légales",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "javascript aktivieren",
    "klicken sie hier", "newsletter abonnieren",
    "todos los derechos reservados", "términos de uso", "condiciones de uso", "política de privacidad", "política de cookies",
    "aceptar cookies", "active javascript", "haga clic aquí", "suscríbete a nuestro boletín", "aviso legal",
)

JUDGED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_failed_lines long, n_failed_words long"
)

_SPACES = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_INSIDE = np.array([0x80 <= b < 0xC0 for b in range(256)])
_SYMBOL = np.array([chr(b) in SYMBOLS for b in range(256)])


def line_fails(line: str, words: list[str]) -> bool:
    """Whether a line with words is navigation, noise, shouting, boilerplate or no sentence."""
    n = len(words)
    if not SENTENCE_END.search(line):
        return True
    if 10 * sum(word in SEPARATORS for word in words) >= n:
        return True
    if sum(map(line.count, SYMBOLS)) >= n:
        return True
    if n >= 3 and 2 * sum(word.isupper() for word in words) > n:
        return True
    if n > PHRASE_WORDS:
        return False
    folded = line.lower()
    return any(phrase in folded for phrase in BOILERPLATE)


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(texts: list[bytes]) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_repeat_words."""
    words = hash_words(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(text) for text in texts], out=ends[1:])
    chars = _per_text(~(_SPACES | _INSIDE)[data], ends)
    symbols = _per_text(_SYMBOL[data], ends)
    repeated = np.zeros(len(words.hashes), bool)
    if len(words.hashes) >= WINDOW:
        row = words.rows()
        n = len(words.hashes) - WINDOW + 1
        whole = row[:n] == row[WINDOW - 1 :]
        # Windows count within their own text, so the text's number is part of the key.
        grams = mix(gram_hashes(words.hashes, WINDOW) + row[:n].astype(np.uint64))[whole]
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        starts = np.zeros(n, bool)
        starts[np.flatnonzero(whole)[twice]] = True
        repeated = covered(starts, WINDOW, len(words.hashes))
    return np.stack([words.counts, chars, symbols, _per_text(repeated, words.bounds)], axis=1)


def judge_lines(text: str) -> tuple[list[str], int, int, int, int]:
    """Lines that stay, then numbers of lines with a word, of copies, of failed lines and of their words."""
    stay, seen = [], set()
    n = copies = failed = lost = 0
    for line in text.split("\n"):
        words = _split(line)
        if not words:
            stay.append(line)
            continue
        n += 1
        copies += line in seen
        seen.add(line)
        if line_fails(line, words):
            failed += 1
            lost += len(words)
        else:
            stay.append(line)
    return stay, n, copies, failed, lost


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_split = _WORD.findall


def _judged(texts: list[bytes], max_loss: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Counts (in the order of JUDGED), base_failed, kept and the cleaned texts."""
    base = np.concatenate([base_counts(texts[a:b]) for a, b in chunks(texts)]) if texts else np.zeros((0, 4), np.int64)
    lines, cleaned = np.zeros((len(texts), 4), np.int64), []
    for i, text in enumerate(texts):
        stay, *lines[i] = judge_lines(text.decode("utf-8", "replace"))
        cleaned.append("\n".join(stay))
    n_words, repeats = base[:, 0], base[:, 3]
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (100 * lines[:, 3] <= max_loss * n_words)
    return np.column_stack([base[:, :3], lines[:, 1], repeats, lines[:, 0], lines[:, 2], lines[:, 3]]), failed, kept, cleaned


def judge(docs: DataFrame, max_loss: int = MAX_LOSS_PERCENT) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and what the line rules found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            numbers, failed, kept, _ = _judged(texts_of(batch.column("text")), max_loss)
            columns = [pa.array(numbers[:, i]) for i in range(8)]
            columns[5:5] = [pa.array(failed), pa.array(kept)]
            names = [part.split()[0] for part in JUDGED.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {JUDGED}")


def clean(docs: DataFrame, max_loss: int = MAX_LOSS_PERCENT) -> DataFrame:
    """The documents that pass, without their failing lines; all columns stay, n_chars follows the text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, kept, cleaned = _judged(texts_of(batch.column("text")), max_loss)
            own = {"text": pa.array(cleaned, pa.string())}
            if "n_chars" in names:
                own["n_chars"] = pa.array(list(map(len, cleaned)), pa.int64()).cast(batch.column("n_chars").type)
            columns = [own[name].cast(batch.column(name).type) if name in own else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


_PHRASES = " OR ".join("contains(lower(line), '{}')".format(phrase.replace("'", "''")) for phrase in BOILERPLATE)

# White space as the pattern of the code knows it.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id
), l AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
), j AS (
  SELECT doc_id, line, len(lw) AS n,
         NOT regexp_matches(line, '[.!?…]["''”’»)\]]*({_SPACE}|$)|[。！？｡．।॥؟۔။።፧።។៕]')
         OR 10 * len(list_filter(lw, lambda x: x IN ('|', '>', '<', '»', '«', '•', '·', '/', '-'))) >= len(lw)
         OR len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) >= len(lw)
         OR (len(lw) >= 3 AND 2 * len(list_filter(lw, lambda x: x = upper(x) AND x <> lower(x))) > len(lw))
         OR (len(lw) <= {PHRASE_WORDS} AND ({_PHRASES})) AS failed
  FROM l WHERE len(lw) > 0
), s AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(n) FILTER (failed), 0)::BIGINT AS n_failed_words
  FROM j GROUP BY doc_id
), a AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ws) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) AS base_failed,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(n_failed_words, 0) AS n_failed_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)
)
SELECT *, NOT base_failed AND 100 * n_failed_words <= {MAX_LOSS_PERCENT} * n_words AS kept FROM a
"""
