"""Operator 12: token ids of all documents in flat binary files that can be memory-mapped.

write_ids() range-sorts the documents by doc_id and lets each task encode its range by the tokenizers library, an end id
after each document, and stream it into two files:

ids-00000.bin  the ids of all its documents, one after the other: little-endian unsigned integers, of 2 bytes if the
               vocabulary has at most 65,536 entries, else of 4
ids-00000.idx  an ENTRY of 24 bytes a document: the end of its ids in the .bin file, counted in ids, and its doc_id

The table `manifest` has a row a file: documents and ids in it, and the documents and ids of all files before it, which are
prefix sums over the files. So the place of a document in the whole corpus is its file's base and its own offset. The
manifest is written last; a folder without it is no corpus. Files are written under another name and renamed, and a rerun
task writes the same bytes, so lost executors leave no half file. read_ids() deals ranges of documents over tasks, which map
the files (or, where the store can't map, read just these ranges).

A vocabulary whose pre-tokenizer drops white space (uses_words()) gives a text the ids of its words at blanks, one after
the other. So each worker asks the library once for each different word of LINE characters, and keeps the answers for up to KEPT words
that came more than once; words and answers lie in Arrow arrays. Where letters and the marks behind them are pre-tokens of their own
and letters are lowered (cuts_marks()), A-Z are lowered and marks cut from Latin letters first, and new words of letters are asked for
as lines of WORDS words that are cut at the vocabulary's ends of words; should their number not fit, one by one. Very long texts are
cut before a blank into pieces of PIECE characters. Any other vocabulary gets whole texts.

Defined cases: a null text is empty and has the end id alone; null doc_ids come first, and are null again when read; rows
with equal doc_id are ordered by a hash of their text, and rows equal in both are interchangeable, and spread over
files where they are many; an empty table gives a manifest without rows; other columns are not used.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh_path, pin, table
from rasterloom.llm.warc import _store

END_ID = 2
#: Words whose ids are kept in a worker, and the longest of them in characters.
KEPT, KEPT_CHARS = 250_000, 64
#: Letters that are one character whatever is done to them, as patterns: Latin without the dotted capital I, which is two in lower case.
LATIN, ODD = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", "\u0130"
#: ASCII marks, as a pattern; the pre-tokenizer cuts between a letter and any of them.
MARKS = r"!-/:-@\[-`{-~"
PIECE = 1 << 20
#: Characters whose words are told apart together, and new words that are asked for together.
LINE, WORDS = 4 << 20, 10_000
#: Documents of a file that are read together, and bytes of ids in a batch.
RANGE, BATCH = 20_000, 1 << 24
ENTRY = np.dtype([("end", "<u8"), ("doc_id", "<i8"), ("known", "<u8")])
MANIFEST = "file string, n_docs long, n_tokens long, width int, base_docs long, base_tokens long"
READ = "doc_id long, start long, n_tokens long, ids binary"
_loaded: dict[str, Encoder] = {}


def uses_words(spec: dict) -> bool:
    """Whether a text's ids are those of its words at blanks: white space is dropped before anything is merged."""
    first = spec.get("pre_tokenizer") or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
    if first.get("type") == "Split":
        drops = first.get("behavior") == "Removed" and first.get("invert") and r"\s" not in first["pattern"].get("Regex", r"\s").replace(r"[^\s", "")
    else:
        drops = first.get("type") in ("Whitespace", "WhitespaceSplit")
    steps = spec.get("normalizer") or {}
    steps = steps.get("normalizers", [steps] if steps else [])
    plain = all(s["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    tokens = spec.get("added_tokens", [])
    return bool(drops and plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] for t in tokens))


def cuts_marks(spec: dict) -> bool:
    """Whether runs of letters and runs of marks are pre-tokens of their own, and letters are lowered."""
    first = spec.get("pre_tokenizer") or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
    kinds = first.get("pattern", {}).get("Regex", "").split("|")
    steps = spec.get("normalizer") or {}
    lowered = any(s["type"] == "Lowercase" for s in steps.get("normalizers", [steps] if steps else []))
    return r"[\p{L}]+" in kinds and r"[^\s\p{L}\p{N}]+" in kinds and lowered


def pieces(text: str, size: int) -> Iterator[str]:
    """The text cut before blanks into pieces of at most size characters, but where a word is longer."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size + 1)
        cut = cut if cut > 0 else text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Encoder:
    """The library's tokenizer of one file, and the ids of words that came again."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # one thread a task: Spark has dealt out the cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, about = Tokenizer.from_str(spec), json.loads(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = uses_words(about)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = id_type(max(vocabulary.values()) + 1)
        tags = about.get("added_tokens", [])
        mark = about["model"].get("end_of_word_suffix") if self.by_word and cuts_marks(about) and not any(t["normalized"] for t in tags) else None
        #: Added tokens with A-Z lowered, as a pattern; texts that hold one are left as they are.
        self.tags = "|".join(re.escape(t["content"].encode().lower().decode()) for t in tags)
        #: Ids that end a pre-token; where there is no such mark, words are asked for one by one.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if mark else None
        if mark:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
            # the same model for lowered Latin letters between blanks, which neither its normalisers nor its pre-tokenizer change but for their bytes
            self.plain, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            bytes_only = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            self.latin.pre_tokenizer = pre_tokenizers.Sequence(bytes_only)
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def in_lines(self, words: list[str], tokenizer) -> pa.Array:
        """The ids of words of one pre-token each, asked for as lines of text and cut where pre-tokens end."""
        out = [pa.array([], pa.large_binary())]
        for some in (words[i : i + WORDS] for i in range(0, len(words), WORDS)):
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.r_[0, np.flatnonzero(self.ends[ids]) + 1] * self.kind.itemsize
            if len(cuts) == len(some) + 1:
                out.append(pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(cuts), pa.py_buffer(ids.astype(self.kind))]))
            else:
                out.append(pa.array(self.one_by_one(some), pa.large_binary()))
        return pa.concat_arrays(out)

    def learn(self, words: pa.Array) -> pa.Array:
        """The ids of words: those of letters are asked for in lines, all others one by one."""
        if self.ends is None:
            return pa.array(self.one_by_one(words.to_pylist()), pa.large_binary())
        plain, latin, letters, odd = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in ("^[a-z]+$", f"^[{LATIN}]+$", r"^\p{L}+$", ODD))
        kind = np.select([plain, latin, letters & ~odd], [0, 1, 2], 3)
        places = [np.flatnonzero(kind == k) for k in range(4)]
        parts = [words.take(pa.array(p)) for p in places]
        found = [
            self.in_lines(parts[0].to_pylist(), self.plain),
            self.in_lines(pc.utf8_lower(parts[1]).to_pylist(), self.latin),
            self.in_lines(parts[2].to_pylist(), self.tokenizer),
            pa.array(self.one_by_one(parts[3].to_pylist()), pa.large_binary()),
        ]
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate(places))))

    def apart(self, texts: pa.Array) -> pa.Array:
        """Texts with A-Z lowered and a blank between letters and the marks behind them, where the library would do the same."""
        lowered = pc.ascii_lower(texts)
        # a capital and an accent may stay two characters where the small letter and it are one
        left = pc.match_substring_regex(texts, r"[A-Z]\p{M}")
        if self.tags:
            left = pc.or_(left, pc.match_substring_regex(lowered, self.tags))
        return pc.if_else(left, texts, pc.replace_substring_regex(lowered, f"([{LATIN}])([{MARKS}])", r"\1 \2"))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.one_by_one(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        chars = 0
        for k, text in enumerate(texts):
            for piece in pieces(text, PIECE):
                held.append((k, piece))
                chars += len(piece)
                if chars > LINE:
                    self.encode_pieces(held, out)
                    held, chars = [], 0
        if held:
            self.encode_pieces(held, out)
        return [b"".join(parts) for parts in out]

    def encode_pieces(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Append the ids of each piece to its text's: words are told apart by Arrow, so that Python sees each new one once."""
        texts = pa.array([piece for _, piece in held], pa.large_string())
        texts = texts if self.ends is None else self.apart(texts)
        lines = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        del texts
        # those known come first, in their order
        known = len(self.words)
        coded = pa.concat_arrays([self.words, lines.flatten()]).dictionary_encode()
        words, place = coded.dictionary, coded.indices[known:]
        ids = pa.concat_arrays([self.ids, self.learn(words[known:])])
        line = ids.take(place)
        _, offsets, raw = line.buffers()
        cuts = np.frombuffer(offsets, np.int64)[lines.offsets.to_numpy()].tolist()
        raw = raw or pa.py_buffer(b"")
        for (k, _), a, b in zip(held, cuts[:-1], cuts[1:], strict=True):
            out[k].append(raw[a:b].to_pybytes())
        again = np.bincount(place.to_numpy(), minlength=len(words)) > 1
        again &= pc.less_equal(pc.utf8_length(words), KEPT_CHARS).to_numpy(zero_copy_only=False)
        kept = again.copy()
        kept[:known] = True
        if kept.sum() > KEPT:
            kept = again & (np.cumsum(again) <= KEPT)
        self.words, self.ids = words.filter(pa.array(kept)), ids.filter(pa.array(kept))


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Write the ids of docs (doc_id, text) into folder, in ascending doc_id order; path: a tokenizers file, read by the driver and broadcast."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        batches = (b for b in batches if len(b))
        if (batch := next(batches, None)) is None:
            return
        if path not in _loaded:
            _loaded[path] = Encoder(held.value)
        encoder = _loaded[path]
        last, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        store, at = _store(folder)
        name = f"ids-{TaskContext.get().partitionId():05d}"
        drafts = {kind: f"{at}/.{name}.{uuid.uuid4().hex}.{kind}" for kind in ("bin", "idx")}
        docs = tokens = 0
        with store.open_output_stream(drafts["bin"], compression=None) as ids, store.open_output_stream(drafts["idx"], compression=None) as index:
            while batch is not None:
                lengths = []
                for one in encoder.encode([t or "" for t in batch["text"]]):
                    ids.write(one + last)
                    lengths.append(len(one) // width + 1)
                entry = np.zeros(len(batch), ENTRY)
                entry["end"] = tokens + np.cumsum(lengths)
                entry["known"] = batch["doc_id"].notna()
                entry["doc_id"] = batch["doc_id"].fillna(0)
                index.write(entry.tobytes())
                docs, tokens = docs + len(batch), int(entry["end"][-1])
                batch = next(batches, None)
        for kind, draft in drafts.items():
            store.move(draft, f"{at}/{name}.{kind}")
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "n_docs": [docs], "n_tokens": [tokens], "width": [width]})

    store, at = _store(folder)
    store.create_dir(at)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "hash", "salt"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("salt"))
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    files = pin(spark, placed.mapInPandas(write, "file string, n_docs long, n_tokens long, width int"), "files")
    # one row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"n_{c}").over(before), F.lit(0)).alias(f"base_{c}") for c in ("docs", "tokens")]
    files.select("file", "n_docs", "n_tokens", "width", *bases).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def mapped(path: str):
    """An open file that is mapped into memory where its store is a file system."""
    from pyarrow import fs

    store, at = _store(path)
    return pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)


def view(f, kind: np.dtype, first: int, last: int) -> np.ndarray:
    """Items first to last (excluded) of a file of items of a kind; a mapped file is not copied."""
    f.seek(first * kind.itemsize)
    return np.frombuffer(f.read_buffer((last - first) * kind.itemsize), kind)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of folder: its doc_id, the place of its first id in the whole corpus, their number, and they themselves in 4 bytes each."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, width, base, n_docs, first in (r for b in batches for r in b.itertuples(index=False)):
            last, kind = min(first + RANGE, n_docs), np.dtype(f"<u{width}")
            with mapped(f"{file}.idx") as f:
                entry = view(f, ENTRY, max(first - 1, 0), last).copy()
            ends = entry["end"].astype(np.int64)
            starts, ends, entry = (ends[:-1], ends[1:], entry[1:]) if first else (np.r_[0, ends[:-1]], ends, entry)
            with mapped(f"{file}.bin") as f:
                # documents whose ids fill a batch together
                group = np.cumsum((ends - starts) * 4 + 64) // BATCH
                for some in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(group)) + 1):
                    ids = view(f, kind, starts[some[0]], ends[some[-1]])
                    cut = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts[some] - starts[some[0]], ends[some] - starts[some[0]], strict=True)]
                    known = pd.array(entry["doc_id"][some], dtype="Int64")
                    known[entry["known"][some] == 0] = pd.NA
                    yield pd.DataFrame({"doc_id": known, "start": base + starts[some], "n_tokens": (ends - starts)[some], "ids": cut})
                    del ids

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest(spark, folder).select("file", "width", F.col("base_tokens"), "n_docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(RANGE).cast("long"))).alias("first"))
    return ranges.repartitionByRange(parts, "file", "first").mapInPandas(fetch, READ)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), folder)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
