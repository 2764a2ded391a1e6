"""Token counts of whole texts, huge ones by overlapping chunks that are resynchronised.

A text longer than a chunk is encoded chunk by chunk, each starting ``overlap``
characters before the end of the one before. The chunks are spliced where both
have a pre-token start at the same character, at least ``MARGIN`` characters
before the end of the earlier one:

* the pre-tokenizer scans forward and looks ahead at most a few characters past
  what it matches, so a pre-token that ends ``MARGIN`` characters before the cut
  is the same in the whole text;
* from a common pre-token start on, both scans see the same text, so the later
  chunk goes on as the whole text would;
* merges stay within pre-tokens, and a special string across the place would be
  seen by the earlier chunk (they are shorter than ``MARGIN``), which would then
  have no pre-token start there.

Where no such place exists the overlap is widened; once it would reach back over
the whole earlier chunk, that chunk is lengthened instead, in the end to the rest
of the text. No token is counted twice or lost, and memory is bounded by the
chunk but for texts without boundaries.

A null text is empty (0 tokens); a null doc_id is an ordinary row, and so is each of
several rows of one doc_id; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame

from roadloom.llm.common import exact_id, ids_of
from roadloom.llm.tokens import load

MARGIN = 32


def _starts(encoding, low: int, high: int, last: bool):
    """Of an encoded chunk: {character: index of the token} for every pre-token start from ``low`` to ``high``; read from the ``last`` token back or from the first on, only as far as needed."""
    found, many = {}, len(encoding)
    for i in range(many - 1, -1, -1) if last else range(many):
        at = encoding.token_to_chars(i)[0]
        if at < low if last else at > high:
            break
        if low <= at <= high:
            word = encoding.token_to_word(i)
            if not i or word is None or word != encoding.token_to_word(i - 1):
                found[at] = max(i, found.get(at, i))
    return found


def count_tokens(tokenizer, text: str, chunk: int = 16_384, overlap: int = 256) -> int:
    """Tokens of ``text``, as encoding it whole gives them."""
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    total, begin, end = 0, 0, min(chunk, len(text))
    current, first = encode(begin, end), 0  # tokens before ``first`` are counted already
    while end < len(text):
        reach, spliced = overlap, False
        while reach < end - begin:
            after = min(end - reach + chunk, len(text)) if end - reach + chunk > end else min(end + chunk, len(text))
            later = encode(end - reach, after)
            shift = end - reach - begin  # of the later chunk against this one
            starts, others = _starts(current, shift + 1, end - begin - MARGIN, True), _starts(later, 1, reach - MARGIN, False)
            common = [c for c in others if starts.get(c + shift, -1) >= first]
            if common:
                place = max(common)
                total += starts[place + shift] - first
                begin, end, current, first, spliced = end - reach, after, later, others[place], True
                break
            reach *= 4
        if not spliced:  # no common boundary: a longer chunk in place of this one, counted from the same token
            end = min(end + max(chunk, end - begin), len(text))
            current = encode(begin, end)
    return total + len(current) - first


class Counter:
    """Tokens of texts of moderate length, by pieces that each start with a space.

    A space followed by anything but white space always starts a pre-token, so the
    pieces between such spaces are encoded alike alone and in place. Each distinct
    piece goes through the library once in a worker process. A text with other
    spaces goes through it whole.
    """

    KEPT = 200_000

    def __init__(self, tokenizer_json: str):
        import re
        import sys
        import types

        self.tokenizer, self.other = load(tokenizer_json), re.compile(r" (?=\s|$)")
        kept = sys.modules.setdefault("_roadloom_counts", types.ModuleType("_roadloom_counts")).__dict__
        self.known = kept.setdefault(f"{len(tokenizer_json)}-{zlib.crc32(tokenizer_json.encode())}", {})

    def count(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.KEPT:
            known.clear()
        library = lambda part: map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))
        pieces = [None if self.other.search(t) else t.split(" ") for t in texts]
        heads = list(library([t if p is None else p[0] for t, p in zip(texts, pieces)]))
        rest = [p[1:] if p else [] for p in pieces]
        missing = list(set().union(*rest).difference(known))
        for lo in range(0, len(missing), 4096):
            part = missing[lo : lo + 4096]
            known.update(zip(part, library([" " + x for x in part])))
        return [h + sum(map(known.__getitem__, r)) for h, r in zip(heads, rest)]


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 1024, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of a few MB

    def run(batches):
        import pandas as pd

        counter = Counter(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                texts = ["" if t is None else t for t in part["text"]]
                small = [i for i, t in enumerate(texts) if len(t) <= chunk]
                counts = [0] * len(texts)
                for i, n in zip(small, counter.count([texts[i] for i in small])):
                    counts[i] = n
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        counts[i] = count_tokens(counter.tokenizer, t, chunk, overlap)
                sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pd.DataFrame({"doc_id": ids_of(part), "n_bytes": sizes, "n_tokens": counts, "over_limit": [c > limit for c in counts]})

    rows = docs.select(*exact_id(), "text")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
