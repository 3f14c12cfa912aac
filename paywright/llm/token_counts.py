"""Token counts of whole texts: batch encoding in Arrow functions that hand back lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from paywright.llm.common import Memo, arrow_batches

#: Places where a byte-level pre-tokenizer starts a new token whatever stands around: white space after a visible
#: character, and ASCII punctuation after a Latin letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PIECE = re.compile(rf"[ \n\r\t]*[{LETTERS}]+(?=[!-/:-@\[-`{{-~ \n\r\t]|\Z)|[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
#: White space beyond the four characters above; texts with it are cut only after a visible ASCII character.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
SAFE_CUT = re.compile(r"(?<=[!-~])(?=[ \n\r\t])")
#: Pieces whose only white space is one blank in front can be encoded side by side as one text.
SIMPLE = re.compile(r" [^ \n\r\t]+\Z")

#: How a byte-level vocabulary writes a blank.
BLANK = "Ġ"
BATCH_BYTES = 256 << 10
GROUP_CHARS = 1 << 20
MEMO_ENTRIES = 250_000
MEMO_CHARS = 64


class Counter:
    """Counts tokens with one tokenizer file; counts of short pieces are remembered, up to ``MEMO_ENTRIES``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo = Memo(MEMO_ENTRIES)
        self.starts = None
        self.special: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.splits = False
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.splits = _cuts_are_safe(path)
            if self.splits:
                self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
                vocabulary = tokenizer.get_vocab()
                self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
                self.starts[[i for t, i in vocabulary.items() if t.startswith(BLANK)]] = True
                self.ids = lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def pieces(self, text: str) -> list[str]:
        if not self.splits:
            return [text] if text else []
        if RARE_SPACE.search(text) or any(t in text for t in self.special):
            return [p for p in SAFE_CUT.split(text) if p]
        return PIECE.findall(text)

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for group in _groups(texts, GROUP_CHARS):
            cut = [self.pieces(t) for t in group]
            long: dict[str, int] = {}
            new = self.memo.missing(set().union(*cut))
            known = self.memo.new
            for piece, n in self._measured(new):
                (known if len(piece) <= MEMO_CHARS else long)[piece] = n
            look = known.__getitem__ if not long else lambda p: long[p] if p in long else known[p]
            out += [sum(map(look, pieces)) for pieces in cut]
        return out

    def _measured(self, pieces: set[str]) -> Iterator[tuple[str, int]]:
        simple = [p for p in pieces if SIMPLE.match(p)] if self.splits else []
        for batch in _groups(simple, BATCH_BYTES):
            starts = np.flatnonzero(self.starts[ids := self.ids("".join(batch))])
            if len(starts) != len(batch):
                raise ValueError("a piece does not start with one blank token")
            yield from zip(batch, np.diff(np.append(starts, len(ids))).tolist(), strict=True)
        for batch in _groups(list(pieces.difference(simple)), BATCH_BYTES):
            yield from zip(batch, self.lengths(batch), strict=True)


def _cuts_are_safe(path: str) -> bool:
    """Whether white space after a visible character always starts a new token with this tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in spec["added_tokens"])
    )


def _groups(texts: list[str], size: int) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``size`` characters; a longer text is a run of its own."""
    run: list[str] = []
    held = 0
    for text in texts:
        if run and held + len(text) > size:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``, in any order.

    ``tokenizer`` is a file every executor can open: .json for ``tokenizers``, .model for ``sentencepiece``. No begin,
    end or added tokens; special strings inside texts are handled as the library does by default. A null text counts as
    the empty one (0 bytes, 0 tokens). Repeated rows and null ids stay as they are; other columns are not read.

    Texts are cut where the tokenizer always starts a new token; pieces that recur are encoded once per worker while a
    bounded memory lasts, in batches of about 256 KiB. A text without such a place is encoded whole.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(tokenizer) or _COUNTERS.setdefault(tokenizer, Counter(tokenizer))
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n = pa.array(counter.count(text.to_pylist()), pa.int64())
            n_bytes = pc.cast(pc.binary_length(text), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
