"""Text decoded in another encoding than it was written in: found by a classifier of the chain, restored by its inverse."""

from __future__ import annotations

import codecs
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.hashing import mix

#: Encodings texts are written in, and read in by mistake, in Python's names.
WESTERN, CENTRAL, CYRILLIC = ["cp1252", "mac_roman", "cp437", "cp850"], ["cp1250", "iso8859_2", "cp852"], ["cp1251", "koi8_r", "cp866", "iso8859_5"]
READ_SINGLE = ["latin_1", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp852", "cp1251", "koi8_r", "cp866", "cp1254", "iso8859_15"]
EAST_ASIAN = ["cp932", "euc_jp"]
READ_MULTI = ["cp932", "gbk", "big5"]
READ_AGAIN = ["latin_1", "cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"]
#: Written in these and read as UTF-8, most bytes beyond ASCII come out as the replacement sign.
REPLACED = ["cp1252", "cp1250", "cp1251", "koi8_r", "mac_roman", "cp932", "euc_jp"]

BUCKETS = 1 << 13
#: Documents the classifier is fitted on, at most; those with the lowest hash of their id.
SAMPLE_DOCS = 3000
#: Verdicts a worker keeps between batches (it saves time only).
STORE = 1 << 18
_SPACE = " \\t\\n\\r\\x0b\\x0c"
_STRETCH = re.compile(rf"(?<![!-~])[!-~]*+[^\x00-\x7f][^{_SPACE}]*")
_EAST = re.compile(r"[⺀-鿿가-힯豈-﫿＀-￯]+")
_HIGH = re.compile(r"[^\x00-\x7f]+")
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f]")
_WITHIN = re.compile(r"[0-9A-Za-z][^\x00-\x7f]|[^\x00-\x7f][0-9A-Za-z]")
_MARK = "\ufeff"  # byte order mark


@lru_cache(None)
def _tables(encoding: str) -> tuple[str, object]:
    """For a single-byte encoding, its signs by byte, and the map back; a byte without a sign stands for the control of its number."""
    signs = []
    for b in range(256):
        try:
            signs.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            signs.append(chr(b))
    return "".join(signs), codecs.charmap_build("".join(signs))


codecs.register_error("nul", lambda e: (b"\0" * (e.end - e.start), e.end))


_SINGLE = {*READ_SINGLE, *WESTERN, *CENTRAL, *CYRILLIC}


def _is_single(encoding: str) -> bool:
    return encoding in _SINGLE


def _encode(s: str, encoding: str, errors: str = "strict") -> bytes:
    return codecs.charmap_encode(s, errors, _tables(encoding)[1])[0] if _is_single(encoding) else s.encode(encoding)


def _decode(b: bytes, encoding: str) -> str:
    return codecs.charmap_decode(b, "strict", _tables(encoding)[0])[0] if _is_single(encoding) else b.decode(encoding)


Chain = tuple[tuple[str, str], ...]


def chains() -> list[Chain]:
    """All (written, read) chains the classifier knows."""
    out: list[Chain] = [(("utf-8", r),) for r in READ_SINGLE + READ_MULTI]
    out += [((w, r),) for w in WESTERN + CENTRAL + CYRILLIC for r in READ_SINGLE if w != r]
    out += [((w, r),) for w in EAST_ASIAN for r in ["latin_1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", *READ_MULTI] if w != r]
    out += [(("utf-8", a), ("utf-8", b)) for a in READ_AGAIN for b in READ_AGAIN]
    out += [(("utf-8", r),) * 3 for r in ("latin_1", "cp1252")]
    return out


def garble(s: str, chain: Chain) -> str:
    for written, read in chain:
        s = _decode(_encode(s, written), read)
    return s


def invert(s: str, chain: Chain) -> str | None:
    """The text that chain made s of; None if s can't be, strictly, its result."""
    try:
        for written, read in reversed(chain):
            s = _decode(_encode(s, read), written)
    except UnicodeError:
        return None
    return s


def garble_all(words: list[str], chain: Chain) -> list[str | None]:
    """garble of each of words (which hold no line ends); None where a sign can't be written so."""
    if any(w in EAST_ASIAN or r in READ_MULTI for w, r in chain):
        out: list[str | None] = []
        for w in words:
            try:
                out.append(garble(w, chain))
            except UnicodeError:
                out.append(None)
        return out
    text = "\n".join(words)
    for written, read in chain:
        text = _decode(_encode(text, written, "nul"), read)
    return [None if "\0" in g else g for g in text.split("\n")]


def lossy(words: list[str]) -> list[tuple[str, list[str]]]:
    """Two more classes, of which nothing can be restored: what words become when they are read as UTF-8 with the replacement sign, and
    those read in latin_1 that get a control from 80 to 9F."""
    replaced, control = [], []
    for w in words:
        for e in REPLACED:
            try:
                g = _encode(w, e).decode("utf-8", "replace")
            except UnicodeError:
                continue
            replaced.append(g if "\ufffd" in g else "")
        for e in ("utf-8", *WESTERN, *CENTRAL, *CYRILLIC):
            try:
                g = _encode(w, e).decode("latin_1")
            except UnicodeError:
                continue
            control.append(g if _CONTROL.search(g) else "")
    return [("replaced", replaced), ("control", control)]


def _reads_as_utf8(w: str, usual: set[str]) -> bool:
    """Whether a run of signs beyond ASCII is UTF-8, of usual signs, as a single-byte encoding shows it."""
    backs = (invert(run, (("utf-8", r),)) for run in _HIGH.findall(w) for r in READ_SINGLE)
    return any(back is not None and usual.issuperset(back) for back in backs)


#: Signs of an East Asian piece: the unit the classifier is fitted on, and judges where a whole run isn't garbled.
PIECE = 16


def pieces(run: str) -> list[str]:
    return [run[i : i + PIECE] for i in range(0, len(run), PIECE)]


def stretches(text: str, whole: bool = False) -> list[str]:
    """The runs without white space that hold signs beyond ASCII, cut where East Asian signs begin or end; East Asian runs as
    pieces, or whole: a garbled run's characters lie across pieces, so only the whole of it can be put right."""
    out = []
    for m in _STRETCH.finditer(text):
        run, at = m[0], 0
        for east in _EAST.finditer(run):
            if east.start() > at:
                out.append(run[at : east.start()])
            out.extend([east[0]] if whole else pieces(east[0]))
            at = east.end()
        if at < len(run):
            out.append(run[at:])
    return [x for x in out if not x.isascii()]


#: The bucket of each pair of bytes.
_BUCKET_OF = (mix(np.arange(1 << 16)) % np.uint64(BUCKETS)).astype(np.uint16)


def features(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte bigram of words (with a mark at both ends) that touches a byte beyond ASCII; the word it is of."""
    raw = [b"\x01" + w.encode("utf-8", "surrogatepass") + b"\x01" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint16)
    of = np.repeat(np.arange(len(raw), dtype=np.int32), [len(x) for x in raw])
    if not len(data):
        return np.zeros(0, np.uint16), of
    keep = (of[1:] == of[:-1]) & ((data[1:] > 127) | (data[:-1] > 127))
    return _BUCKET_OF[(data[:-1] << np.uint16(8) | data[1:])[keep]], of[:-1][keep]


def _counted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """features, with the number of bigrams of each word instead of the word of each: what the fit holds for every chain at once."""
    bucket, of = features(words)
    return bucket, np.bincount(of, minlength=len(words)).astype(np.int32)


class Model:
    """Multinomial classifier over hashed byte bigrams: class 0 is clean text, the others are chains."""

    def __init__(self, counted: Counter[str]) -> None:
        """counted: stretches of a sample, with the number of documents each is in; unlabelled, most of them clean.

        The labelled rows are made of it: each stretch as it is, and garbled by each chain. Part of the sample is garbled
        already and is left out: what decodes strictly as UTF-8 read in a single-byte encoding, what is the
        result of a chain on a stretch (of three signs or more) that more documents hold, and, in a second fit, what the first one finds.
        """
        self.chains: list[Chain | None] = [None]
        self.plain = 0.0
        self.sampled = counted
        signs: Counter[str] = Counter()
        for w, n in counted.items():
            for ch in set(w):
                signs[ch] += n
        usual = {ch for ch, n in signs.items() if n >= 3}
        counted = Counter({w: n for w, n in counted.items() if "�" not in w and not _CONTROL.search(w) and not _reads_as_utf8(w, usual)})
        self.counted = counted
        words = sorted(counted)
        derived: set[str] = set()
        rows: list[tuple[Chain | None, np.ndarray, np.ndarray]] = [(None, *_counted(words))]
        for chain in chains():
            made = garble_all(words, chain)
            derived.update(g for w, g in zip(words, made) if g is not None and len(g) > 2 and g != w and counted[w] > counted.get(g, sys.maxsize))
            rows.append((chain, *_counted(["" if g is None or g == w or g.isascii() else g for w, g in zip(words, made)])))
        # of letters as well, so that these classes are there whatever the sample holds
        base = words + [f"a{chr(c)}e" for c in (*range(0xA1, 0x180), *range(0x410, 0x450))]
        self.lossy = [(name, features(made)[0]) for name, made in lossy(base)]
        for _ in range(2):
            self._fit(words, derived, rows)
            derived.update(w for w, v in self.verdicts([w for w in words if w not in derived]).items() if v[0])
        self._fit(words, derived, rows)

    def _fit(self, words: list[str], without: set[str], rows: list[tuple[Chain | None, np.ndarray, np.ndarray]]) -> None:
        weight = np.array([0.0 if w in without else self.counted[w] for w in words])
        counts = [(chain, np.bincount(bucket, weights=np.repeat(weight, sizes), minlength=BUCKETS)) for chain, bucket, sizes in rows]
        counts = [(chain, n) for chain, n in counts if chain is None or n.any()]
        self.chains = [chain for chain, _ in counts]
        self.names = ["", *("+".join(f"{w}>{r}" for w, r in chain) for chain in self.chains[1:]), *(name for name, _ in self.lossy)]
        table = np.array([n for _, n in counts] + [np.bincount(bucket, minlength=BUCKETS).astype(float) for _, bucket in self.lossy])
        self.log = np.log((table + 0.02) / (table.sum(1, keepdims=True) + 0.02 * BUCKETS)).astype(np.float32)
        self.signs = {ch for w, n in zip(words, weight) if n for ch in w if ch > "\x7f"}
        mean = np.repeat(self.means(words), np.minimum(weight, 50).astype(int)) if words else np.zeros(0)
        self.plain = float(np.quantile(mean, 0.01)) if len(mean) else -8.0

    def means(self, words: list[str]) -> np.ndarray:
        """Mean log-probability, as clean text, of the bigrams of each word."""
        bucket, of = features(words)
        n = np.bincount(of, minlength=len(words))
        return np.bincount(of, weights=self.log[0][bucket], minlength=len(words)) / np.maximum(n, 1)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word (row) in each class."""
        bucket, of = features(words)
        out = np.zeros((len(words), len(self.log)))
        start = np.searchsorted(of, np.arange(len(words)))
        for a in range(0, len(words), 512):
            b = min(a + 512, len(words))
            lo, hi = start[a], start[b] if b < len(words) else len(of)
            if hi > lo:
                s = start[a:b] - lo
                out[a:b] = np.add.reduceat(self.log[:, bucket[lo:hi]], s, axis=1).T
        return out

    def told(self, w: str, back: str) -> bool:
        """Whether the letters and digits beside its signs tell that w stands for back: sampled texts hold back, and more of them than w."""
        return bool(_WITHIN.search(w)) and self.sampled.get(back, 0) > self.sampled.get(w, 0)

    def verdicts(self, words: list[str], margin: float = 6.0) -> dict[str, tuple[int, str | None, str]]:
        """For each word: whether it is garbled (2: surely, 1: if its text has another such word, 0: not), its original
        (None if it can't be told) and the chain's name. 1 is for single-byte encodings and a word of
        one or two letters, which may be a word of another language, or without a letter beyond ASCII: a dash, a
        currency sign or a hard space within a word may be meant; unless it stands for a usual stretch (see told).

        All chains that explain a word better than clean text does are tried, from the likeliest on. A chain holds if its
        inverse decodes strictly, over the whole word or over each run of signs beyond ASCII that it
        decodes, and gives text that is likelier as clean text, and as likely as known words are. A word with the
        replacement sign, or with a control from 80 to 9F besides the line end 85, that no chain holds for is garbled beyond
        repair if any class explains it better than clean text, of which such signs are no part.
        """
        out: dict[str, tuple[int, str | None, str]] = {}
        if not words:
            return out
        score = self.scores(words)
        own = self.means(words)
        asked: list[tuple[int, int, str]] = []
        for i, w in enumerate(words):
            if "�" in w:
                continue
            known = score[i, : len(self.chains)]
            better = np.flatnonzero(known > known[0] + 3.0)
            seen = set()
            for c in better[np.argsort(-known[better], kind="stable")]:
                chain = self.chains[c]
                back = invert(w, chain)
                if back is None:
                    parts = [(x, invert(x, chain)) for x in _HIGH.findall(w)]
                    if not any(p for _, p in parts):
                        continue
                    todo = iter(p or x for x, p in parts)
                    back = _HIGH.sub(lambda m: next(todo), w)  # noqa: B023
                if back != w and back not in seen and not any(ch < " " or "\x7f" <= ch < "\xa0" for ch in back):
                    seen.add(back)
                    asked.append((i, int(c), back))
        if asked:
            texts = [b.lstrip(_MARK) for _, _, b in asked]
            mean = self.means(texts)
            clean = self.log[0]
            bucket, of = features(texts)
            total = np.bincount(of, weights=clean[bucket], minlength=len(texts))
            unseen = np.bincount(of, weights=clean[bucket] < clean.min() + 1, minlength=len(texts)) > 0
            best: dict[int, tuple[float, str, int]] = {}
            for j, (i, c, back) in enumerate(asked):
                unicode = self.chains[c][0][0] == "utf-8"
                if texts[j].isascii():
                    gain, sure = -score[i, 0] - 12.0, own[i] < self.plain
                else:
                    gain, sure = total[j] - score[i, 0], mean[j] >= self.plain and mean[j] > own[i] + 1.0
                if unicode:
                    sure = sure or self.signs.issuperset(ch for ch in texts[j] if ch > "\x7f")
                else:  # most bytes can be read so: what comes out must be known text
                    sure = sure and not unseen[j] and not _MIXED.search(back)
                n = self.sampled.get(words[i], 0)
                if not unicode and n >= 5 and self.sampled.get(back, 0) < n:  # a usual word, more so than what it would come from
                    continue
                if sure and gain > margin and (i not in best or gain > best[i][0]):
                    best[i] = (gain, back, c)
            for i, (_, back, c) in best.items():
                letters = [ch for ch in words[i] if ch.isalpha()]
                maybe = self.chains[c][0][0] != "utf-8" and (len(letters) < 3 or max(letters) < "\x80")
                maybe = maybe and not _CONTROL.search(words[i]) and not self.told(words[i], back)
                out[words[i]] = (1 if maybe else 2, back, self.names[c])
        for i, w in enumerate(words):
            lost = w not in out and ("�" in w or _CONTROL.search(w)) and score[i].argmax()
            out.setdefault(w, (2, None, self.names[score[i].argmax()]) if lost else (0, None, ""))
        return out

    def run_verdicts(self, run: str, judged: dict[str, tuple[int, str | None, str]]) -> list[tuple[str, tuple[int, str | None, str]]]:
        """What an East Asian run consists of, with verdicts: itself, if it is garbled as a whole; else its pieces, where those from the
        first garbled one to the last, with up to a piece more or three signs less at both ends, are put right as one if any
        of their chains can be inverted over them."""
        if judged[run][0] or len(run) <= PIECE:
            return [(run, judged[run])]
        parts = [(p, judged[p]) for p in pieces(run)]
        bad = [i for i, (_, v) in enumerate(parts) if v[0]]
        if not bad:
            return parts
        start, end = bad[0] * PIECE, min((bad[-1] + 1) * PIECE, len(run))
        by_name = {name: chain for name, chain in zip(self.names, self.chains) if chain}
        for name in dict.fromkeys(parts[i][1][2] for i in bad):
            spans = sorted((z - a, a, z) for a in range(max(start - PIECE + 1, 0), start + 4) for z in range(end - 3, min(end + PIECE, len(run)) + 1) if z > a)
            for _, a, z in reversed(spans):
                back = invert(run[a:z], by_name[name]) if name in by_name else None
                if back and back != run[a:z] and self.means([back])[0] >= self.plain:
                    rest = [(x, (0, None, "")) for x in (run[:a], run[z:])]
                    return [rest[0], (run[a:z], (2, back, name)), rest[1]]
        return parts


    def clean_likelihood(self, text: str) -> float:
        return float(self.log[0][features(stretches(text))[0]].sum())

    def whole_text(self, text: str, restored: str, names: list[str]) -> str | None:
        """text put right by one chain as a whole, if one of the chains of its stretches can be inverted over all of it and that makes it
        likelier as clean text than what was made stretch by stretch: stretches too weak to be told alone go with the others."""
        best, best_text = self.clean_likelihood(restored), None
        by_name = {name: chain for name, chain in zip(self.names, self.chains) if chain}
        for name in names:
            back = invert(text, by_name[name]) if name in by_name else None
            if back is None or back in (text, restored) or any("\x7f" <= ch < "\xa0" for ch in back):
                continue
            likelihood = self.clean_likelihood(back)
            if likelihood > best:
                best, best_text = likelihood, back
        return best_text


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> Model:
    """A model fitted on the texts beyond ASCII of at most sample rows, those with the lowest hash of their key.

    Rows are thinned out by the hash before they are ordered, to some four times sample of all rows, so that
    what is ordered doesn't grow with df; where few texts are beyond ASCII, the sample is smaller.
    """
    share = min(1.0, 4.0 * sample / max(df.count(), 1))
    h = F.xxhash64(key)
    high = df.where((F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))) & (F.octet_length(text) > F.length(text)))
    rows = high.select(key, text).orderBy(h, key).limit(sample).select(text).toArrow().column(0).to_pylist()
    counted: Counter[str] = Counter()
    for t in rows:
        counted.update(set(stretches(t)))
    return Model(counted)


def garbled(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Of the rows of df with garbled text: key, n_garbled (stretches), n_restored, chains ARRAY<STRING>, restored STRING.

    restored is the text with every stretch whose chain could be inverted put right, or the whole of it by one chain (see whole_text). Null, empty and ASCII texts
    are no cases, and are sorted out before they reach Python. The classifier's size doesn't depend on df; it is
    broadcast. Each text is judged whole, for itself. Columns besides key and text are ignored.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(df, key, text))
    store: dict[str, tuple[int, str | None, str]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            parts = [stretches(t, True) for t in texts]
            words = {w for p in parts for w in p}
            words |= {x for w in words if len(w) > PIECE and _EAST.fullmatch(w) for x in pieces(w)}
            new = words - store.keys()
            if len(store) + len(new) > STORE:
                store.clear()
                new = words
            store.update(judge.verdicts(sorted(new)))
            keep, rows = [], []
            for i, (t, p) in enumerate(zip(texts, parts)):
                told = [x for w in p for x in (judge.run_verdicts(w, store) if len(w) > PIECE and _EAST.fullmatch(w) else [(w, store[w])])]
                bad = [(w, v) for w, v in told if v[0]]
                if any(v[0] > 1 for _, v in bad) or len({w for w, _ in bad}) > 1:
                    at, made = 0, []
                    for w, (found, back, _) in told:  # in their order
                        to = t.index(w, at)
                        made += [t[at:to], back if found and back is not None else w]
                        at = to + len(w)
                    restored, names = "".join(made) + t[at:], sorted({v[2] for _, v in bad})
                    keep.append(i)
                    rows.append((len(bad), sum(v[1] is not None for _, v in bad), names, judge.whole_text(t, restored, names) or restored))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(keep, pa.int32())),
                    pa.array(cols[0], pa.int32()),
                    pa.array(cols[1], pa.int32()),
                    pa.array(cols[2], pa.list_(pa.string())),
                    pa.array(cols[3], pa.string()),
                ],
                names=[key, "n_garbled", "n_restored", "chains", "restored"],
            )

    high = df.where(F.octet_length(text) > F.length(text)).select(key, text)
    spec = f"`{key}` {df.schema[key].dataType.simpleString()}, n_garbled int, n_restored int, chains array<string>, restored string"
    return high.mapInArrow(run, spec)
