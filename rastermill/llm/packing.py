"""Order-preserving packing of token streams into fixed windows by dynamic programming with a monotone queue."""

from __future__ import annotations

import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import held

#: White space as spaces, but line breaks; the mark of a sentence's end among the words (a byte that no text has).
SPACES, CUT = bytes.maketrans(b"\t\x0b\x0c\r", b"    "), b"\xff"
#: What stands for that mark among ids.
NO_ID = 0xFFFFFFFF
#: Signs at the end of a word that are tokens of their own.
TAIL = b".,;:!?&%#*$()"
#: ASCII and the bytes of Latin-1 letters; signs as "p", but the two that are parted from words in whole texts as "q".
PLAIN = bytes(range(128)) + bytes(range(128, 192)) + b"\xc3"
KINDS = bytes(113 if x in b",." else 112 if 32 < x < 127 and not chr(x).isalnum() or x < 32 and x not in b"\t\n\v\f\r" or x == 127 else 32 if x < 33 else 97 for x in range(256))
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) of words between white space; remembers at most two generations of words.

    The tokenizer drops white space and never joins over it, so a text's ids are its words' ids one after another. New
    words are tokenized many at a time: ASCII ones are told apart by the bytes that each id stands for, others by the id
    of MARK between them. Where the tokenizer makes small letters of capitals and parts words from the signs behind them,
    which is tried on loading, fewer different words are left to tokenize.
    """

    bound, many = 300_000, 2000
    MARK = "\x02"  # one pre-token and one id; a word that holds it is tokenized by itself

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[k] = len(token.removesuffix("</w>"))  # a letter of the vocabulary is a byte
        for k, added in self.tokenizer.get_added_tokens_decoder().items():
            self.sizes[k] = len(added.content.encode())
        same = lambda a, *parts: self.encode(a).tolist() == [k for x in parts for k in self.encode(x).tolist()]
        self.lowers = same("ABCDEFGHIJ KLMNOPQRS TUVWXYZ IT'S", "abcdefghij klmnopqrs tuvwxyz it's")
        last = {added.content.encode()[-1] for added in self.tokenizer.get_added_tokens_decoder().values() if added.content}
        signs = [chr(x) for x in TAIL if x not in last]
        self.tail = "".join(x for x in signs if all(same(w + x + y, w, x + y) for w in ("word", "caf\xe9", "x7") for y in ("", *signs))).encode()
        self.parts = b"," in self.tail and b"." in self.tail
        self[CUT] = NO_ID.to_bytes(4, "little")

    def words(self, text: str | None) -> list[bytes]:
        """The words of a text, and CUT at the ends of its sentences: behind white space after a full stop, question or
        exclamation mark, and at line breaks. A letter before a combining mark and added tokens stay as they are."""
        e = (text or "").encode()
        if self.lowers and b"\xcc" not in e and b"\xcd" not in e and b"<|" not in e:
            e = e.lower()
        e = e.translate(SPACES)
        if self.parts and not e.translate(None, PLAIN) and b"\xc3\x97" not in e and b"\xc3\xb7" not in e:
            kinds = e.translate(KINDS)
            if b"pq " not in kinds and b"qq " not in kinds and b" q " not in kinds and not kinds.startswith(b"q "):
                e = e.replace(b", ", b" , ").replace(b". ", b" . ")
        e = e.replace(b"\n", b" \xff ")
        for end in (b". ", b"! ", b"? "):
            e = e.replace(end, end + b"\xff ")
        return e.split()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def put(self, words: list[bytes], ids: np.ndarray, starts, ends) -> None:
        data = ids.tobytes()
        self.update(zip(words, [data[4 * a : 4 * b] for a, b in zip(starts, ends)]))

    def learn(self, texts: list[list[bytes]]) -> None:
        """Remember the ids of all words of the texts, of whatever number."""
        new = set().union(*texts) - self.keys()
        if len(self) + len(new) > self.bound:
            self.older = dict(self)
            self.clear()
            self[CUT] = NO_ID.to_bytes(4, "little")
            new = set().union(*texts) - self.keys()
        old = self.older.keys() & new
        self.update((w, self.older[w]) for w in old)
        new -= old
        parted = {}
        for w in new:
            core = w.rstrip(self.tail)
            if core and len(core) < len(w) and (core[-1] < 128 and core[-1:].isalnum() or core[-1] > 127 and "\xc0" <= (c := core.decode()[-1]) < "\u0250" and c.isalpha() and c.lower().isalpha()):
                parted[w] = core
        new.difference_update(parted)
        new.update(x for x in {*parted.values(), *(w[len(c) :] for w, c in parted.items())} if x not in self)
        self.tokenize(new)
        self.update([(w, self[c] + self[w[len(c) :]]) for w, c in parted.items()])

    def tokenize(self, new: set[bytes]) -> None:
        plain = [w for w in new if w.isascii()]
        for k in range(0, len(plain), self.many):
            words = plain[k : k + self.many]
            ids = self.encode(b" ".join(words).decode())
            at, wanted = np.cumsum(self.sizes[ids]), np.cumsum([*map(len, words)])
            ends = np.searchsorted(at, wanted) + 1
            if len(ids) and ends[-1] == len(ids) and (at[ends - 1] == wanted).all():
                self.put(words, ids, [0, *ends[:-1].tolist()], ends.tolist())
            else:
                new.difference_update(plain[:k])
                break
        else:
            new.difference_update(plain)
        rest = [*new]
        for k in range(0, len(rest), self.many):
            words = rest[k : k + self.many]
            ids = self.encode(f" {self.MARK} ".join(w.decode() for w in words))
            marks = np.flatnonzero(ids == self.mark).tolist()
            if len(marks) == len(words) - 1:
                self.put(words, ids, [0, *(x + 1 for x in marks)], [*marks, len(ids)])
            else:
                for w in words:
                    self[w] = self.encode(w.decode()).tobytes()


def load(path: str) -> WordIds:
    return held(("words", path), lambda: WordIds(path))


def cuts(ends: list[int], penalties: list[int], width: int, unpadded: tuple[int, ...] = ()) -> list[int]:
    """Indices of the chosen window ends (the last one always), given the allowed ends (rising) and their penalties.

    cost[j] = penalty[j] + width - (end[j] - end[i]) + cost[i], least over the i that lie at most width before j. In
    cost[i] + end[i] the choice no longer depends on j, so a queue with rising values holds the least one. Windows of a
    length in `unpadded` cost no padding: those few transitions are looked up by their end.
    """
    at = [0, *ends]
    back, values = [0] * len(at), [0] * len(at)
    places = np.array(at, np.int64)
    starts = []  # the end that lies n before each, -1 if none does
    for n in unpadded:
        k = np.searchsorted(places, places - n)
        starts.append((n, np.where(places[k] == places - n, k, -1).tolist()))
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(at)):
        here, penalty = at[j] - width, penalties[j - 1]
        while at[queue[0][1]] < here:
            queue.popleft()
        value, back[j] = queue[0]
        value += width + penalty  # = cost[j] + end[j]
        for n, start in starts:
            if (i := start[j]) >= 0 and values[i] + n + penalty < value:
                value, back[j] = values[i] + n + penalty, i
        values[j] = value
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chosen, j = [], len(at) - 1
    while j:
        chosen.append(j - 1)
        j = back[j]
    return chosen[::-1]


class Packer:
    """Packs documents in the order given; sequences come out as soon as a block of tokens is full."""

    def __init__(self, width: int, sentence_penalty: int, word_penalty: int, block: int, first_id: int):
        self.width, self.sentence, self.word, self.block, self.next = width, sentence_penalty, word_penalty, block, first_id
        self.unpadded = tuple(n for n in (width // 2, width // 4) if n & (n - 1) == 0 and n)
        self.docs: deque = deque()  # doc_id, bytes of ids, tokens already placed
        self.ends, self.penalties, self.total = [], [], 0

    def add(self, doc_id, ids: bytes, sizes: list[int]) -> None:
        """A document's ids, and how many of them each sentence has."""
        self.docs.append([doc_id, ids, 0])
        step = self.width // 32
        for k, n in enumerate(sizes):
            for x in range(step, n, step):  # no sentence is longer than a window: it may be cut between words of ids
                self.ends.append(self.total + x)
                self.penalties.append(self.word)
            if n:
                self.total += n
                self.ends.append(self.total)
                self.penalties.append(self.sentence if k < len(sizes) - 1 else 0)

    def rows(self, last: bool):
        """Pieces of the sequences that are final: all at the last call, else all but the last sequence."""
        if not self.ends or not last and self.total < self.block:
            return
        chosen = cuts(self.ends, self.penalties, self.width, self.unpadded)
        if not last:
            chosen.pop()
        done = 0
        for j in chosen:
            end, offset = self.ends[j], 0
            while done < end:
                doc_id, ids, start = doc = self.docs[0]
                n = min(end - done, len(ids) // 4 - start)
                yield doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, self.next, offset
                doc[2], offset, done = start + n, offset + n, done + n
                if doc[2] == len(ids) // 4:
                    self.docs.popleft()
            self.next += 1
        keep = chosen[-1] + 1 if chosen else 0
        self.ends, self.penalties, self.total = [e - done for e in self.ends[keep:]], self.penalties[keep:], self.total - done


def pack(docs: DataFrame, tokenizer_path: str, width: int = 2048, end_id: int = 1, sentence_penalty: int = 4, word_penalty: int = 10, block: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most `width` ids: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents stay in the order in which a partition of docs holds them (sort first for another order) and every
    partition packs on its own: no shuffle, memory of one block of ids and one document. Windows end at document or
    sentence ends, or at every 32nd of a window within a longer sentence, so that padding plus penalties are least; a
    window of a half or a quarter of `width` is not padded if that is a power of two. The horizon rolls: cuts are
    least for each `block` ids of a partition, of which the last window is planned again with the next block, and
    not over the whole table. A very long text takes as many windows as it needs; equal costs take the earlier cut.
    A document is its ids and end_id. A null or empty text is end_id alone; a null id stays null; repeated rows are
    packed each; an empty table gives an empty one; other columns of docs play no part, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = array("I", [end_id]).tobytes()

    def run(batches):
        ids = load(tokenizer_path)
        packer = Packer(width, sentence_penalty, word_penalty, block, TaskContext.get().partitionId() << 40)
        id_type = None

        def out(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for b in batches:
            id_type = b.column(0).type
            for k in range(0, len(b), 512):
                texts = [ids.words(x) for x in b.column(1).slice(k, 512).to_pylist()]
                ids.learn(texts)
                for doc_id, text in zip(b.column(0).slice(k, 512).to_pylist(), texts):
                    x = np.frombuffer(b"".join(map(ids.__getitem__, text)) + end, "<u4")
                    cut = np.flatnonzero(x == NO_ID)
                    sizes = np.diff(cut, prepend=-1, append=len(x)) - 1
                    packer.add(doc_id, (x[x != NO_ID] if len(cut) else x).tobytes(), sizes.tolist())
                    if packer.total >= block and (rows := list(packer.rows(False))):
                        yield out(rows)
        if rows := list(packer.rows(True)):
            yield out(rows)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
