"""Token ids of whole texts by a tokenizer file that lower-cases and drops white space.

There, white space never takes part in a token, and neither normalisation nor
merges reach across it; a letter and a following mark of punctuation, but for the
apostrophe of contractions, never share a token either, nor compose. So a text's ids are those of its pieces between such
places, one after the other, and A-Z may be lower-cased beforehand. Each distinct
piece goes through the library once in a worker process and its ids are kept as
bytes; the pieces of many texts are told apart by 64-bit keys, on whole arrays, and
looked up once each. Special strings are matched before
normalisation, so a text that may hold one goes through the library whole.
"""

from __future__ import annotations

from array import array

from roadloom.llm.pieces import piece_keys, same_keys, word_places

#: Pieces kept by a worker process before it starts anew: bounds its memory, not its results.
KEPT_PIECES = 300_000
#: Marks that always end a run of letters.
MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: ASCII white space as spaces.
PLAIN = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def load(tokenizer_json: str):
    """A tokenizer that runs on the task's own core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def numbered_pieces(texts: list[bytes]):
    """The distinct pieces of texts, each text's number of pieces, and all pieces as places among the distinct ones.

    Texts are parted by ASCII white space and between a-z and one of MARKS.
    """
    import numpy as np

    kind = np.zeros(256, np.uint8)
    kind[ord("a") : ord("z") + 1] = 1
    kind[list(MARKS)] = 2
    joined = np.frombuffer((b" ".join(texts) + b" ").translate(PLAIN), np.uint8)
    kinds = kind[joined]
    cuts = np.flatnonzero((kinds[:-1] == 1) & (kinds[1:] == 2)) + 1
    data = np.insert(joined, cuts, 32).tobytes()
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, sizes = word_places(data)
    lengths = np.diff(np.searchsorted(starts, begins + np.searchsorted(cuts, begins)))
    if not len(starts):
        return [], lengths, np.zeros(0, np.int32)
    places, first = same_keys(piece_keys(data, starts, sizes))
    return [data[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist())], lengths, places


class PieceEncoder:
    """``encode(texts)``: for each text (null: empty) its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str, kept_pieces: int = KEPT_PIECES):
        import sys
        import types
        import zlib

        self.tokenizer, self.kept_pieces = load(tokenizer_json), kept_pieces
        # Where a run of a-z is a pre-token as it stands, the library's merge model takes it at once.
        ready, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.direct = ready is not None and cut is not None and ready.normalize_str("az") == "az" and [x for x, _ in cut.pre_tokenize_str("az")] == ["az"]
        from tokenizers.pre_tokenizers import ByteLevel

        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.direct_any = self.direct and all([x for x, _ in cut.pre_tokenize_str(s)] == [self.bytes_of(s)[0][0]] for s in ("éß", "ñ中"))
        self.specials = tuple(t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values())
        # Spark reuses worker processes: what a task has learned serves the process's next one.
        kept = sys.modules.setdefault("_roadloom_pieces", types.ModuleType("_roadloom_pieces")).__dict__
        self.known = kept.setdefault(f"{len(tokenizer_json)}-{zlib.crc32(tokenizer_json.encode())}", {})

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts) -> list[bytes]:
        import numpy as np

        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        whole = {i for i, t in enumerate(raw) if any(s in t for s in self.specials)}
        pieces, lengths, places = numbered_pieces([b"" if i in whole else t.lower() for i, t in enumerate(raw)])
        known = self.known
        if len(known) > self.kept_pieces:
            known.clear()
        missing = [x for x in pieces if x not in known]
        if self.direct:
            merge, plain = self.tokenizer.model.tokenize, [x for x in missing if x.isalpha()]
            known.update((x, array("I", [t.id for t in merge(x.decode())]).tobytes()) for x in plain)
            missing = [x for x in missing if not x.isalpha()]
        if self.direct_any:  # other letters too, where normalisation has nothing to do
            from unicodedata import is_normalized

            rest = []
            for x in missing:
                s = x.decode("utf-8", "replace")
                if s.isalpha() and s == s.lower() and is_normalized("NFC", s):
                    known[x] = array("I", [t.id for t in merge(self.bytes_of(s)[0][0])]).tobytes()
                else:
                    rest.append(x)
            missing = rest
        for lo in range(0, len(missing), 4096):
            part = missing[lo : lo + 4096]
            known.update(zip(part, self._library([x.decode("utf-8", "replace") for x in part])))
        found = [known[x] for x in pieces]
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, sizes = (np.cumsum(sizes) - sizes)[places], sizes[places]
        ends = np.cumsum(sizes)
        data = ids.take(np.repeat(begins - (ends - sizes), sizes) + np.arange(sizes.sum())).tobytes()
        cuts = (4 * np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))]).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in whole:
            out[i] = self._library([raw[i].decode("utf-8", "replace")])[0]
        return out


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
