"""Language of a text by unigram pieces, summed over all segmentations."""

import dataclasses
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from habitloom.llm.common import kept_in_worker, pick
from habitloom.operators.ranking import exact_percentiles
from habitloom.session import materialize

# Longer pieces of the vocabulary are left out.
PIECE = 16
# Probability of a letter by itself where no piece of the vocabulary holds it.
UNKNOWN = 1e-7
WORDS_AT_ONCE = 4096
# Places of the prefix sums that are held at once; one longer word is held alone.
PLACES_AT_ONCE = 1 << 17
TEXTS_AT_ONCE = 64
# Labelled rows that limits of evidence are taken from, at least; languages with fewer share one limit.
LEAST_ROWS = 20
# Times the usual logarithm per letter that a text of a learned language may have. On the test data,
# texts of languages that were not learned have more than twice the usual one.
SLACK = 1.75
# Names for what ``predict`` gives as evidence.
EVIDENCE = ("log", "letters", "words")


@dataclasses.dataclass(frozen=True)
class Model:
    """Piece probabilities: a row per piece of the vocabulary and one for unknown letters, a column per language."""

    pieces: tuple[str, ...]
    languages: tuple[str, ...]
    probabilities: np.ndarray


def vocabulary(model_path: str) -> tuple[str, ...]:
    """Pieces of a public vocabulary that are letters, alone or behind the word mark, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return tuple(dict.fromkeys(p for p in pieces if len(p) <= PIECE and p.removeprefix("▁").isalpha() and p == p.lower()))


def letters(text: Column) -> Column:
    """Runs of letters of a text in lower case, separated by blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def _in_blocks(words):
    """Places of the words, by length, in blocks whose prefix sums take little memory."""
    block = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if block and (len(block) == WORDS_AT_ONCE or (len(block) + 1) * (len(words[i]) + 2) > PLACES_AT_ONCE):
            yield block
            block = []
        block.append(i)
    if block:
        yield block


class _Pieces:
    """All beginnings of pieces as numbered states: which letter leads from one to which, and the piece that each is, or -1."""

    def __init__(self, pieces):
        self.unknown = len(pieces)
        states = {"": 0}
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                states.setdefault(piece[:k], len(states))
        self.pieces = np.full(len(states), -1)
        self.pieces[[states[p] for p in pieces]] = np.arange(len(pieces))
        alphabet = {c: i for i, c in enumerate(sorted(set("".join(pieces))), 1)}
        # Letters of no piece, and whatever lies beyond, have number 0.
        self.letters = np.zeros(max(map(ord, alphabet), default=0) + 2, np.int64)
        self.letters[[ord(c) for c in alphabet]] = list(alphabet.values())
        self.width = len(alphabet) + 1
        steps = sorted((states[s[:-1]] * self.width + alphabet[s[-1]], state) for s, state in states.items() if s)
        self.steps = np.array([step for step, _ in steps] + [np.iinfo(np.int64).max])
        self.next = np.array([state for _, state in steps] + [0])

    def numbered(self, texts):
        """Letters of the texts as numbers, each text followed by a 0."""
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.letters[np.minimum(codes, len(self.letters) - 1)]

    def follow(self, state, letter):
        """Which of the states lead on by their letter, and where those lead."""
        step = state * self.width + letter
        at = np.searchsorted(self.steps, step)
        on = np.flatnonzero((self.steps[at] == step) & (letter > 0))
        return on, self.next[at[on]]


class _Lattice:
    """All segmentations of some words with their marks: for each start, which piece leads from it to which end.

    Sums are scaled anew every ``PIECE`` letters: no step reaches further, so
    all sums of such a block have one scale, kept as a logarithm, and words of
    any length neither vanish nor need a cut.
    """

    def __init__(self, texts, pieces):
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        letters, before = pieces.numbered(texts), np.cumsum(self.lengths + 1) - self.lengths - 1
        word = np.repeat(np.arange(len(texts)), self.lengths)
        start = np.arange(len(word)) - np.repeat(before - np.arange(len(texts)), self.lengths)
        place = start + before[word]
        # All starts at once, a letter further each round; most leave after a few.
        active, state, found = np.arange(len(word)), np.zeros(len(word), np.int64), []
        for size in range(1, PIECE + 1):
            on, state = pieces.follow(state, letters[place[active] + size - 1])
            active, piece = active[on], pieces.pieces[state]
            whole = np.flatnonzero(piece >= 0)
            of, piece = active[whole], piece[whole]
            if size == 1:
                # Where no piece is the letter alone, it is a step by itself.
                single = np.full(len(word), pieces.unknown)
                single[of] = piece
                of, piece = np.arange(len(word)), single
            found.append((of, np.full(len(of), size), piece))
            if not len(active):
                break
        of, size, piece = (np.concatenate(column) for column in zip(*found))
        # Stable sorts of short numbers take no comparisons.
        first = start[of]
        order = np.argsort(first.astype(np.uint16) if self.lengths.max(initial=0) < 1 << 16 else first, kind="stable")
        of = of[order]
        self.word, self.start, self.piece = word[of], start[of], piece[order]
        self.end = self.start + size[order]
        self.cuts = np.searchsorted(self.start, np.arange(self.lengths.max(initial=0) + 1))

    def _empty(self, width):
        most = int(self.lengths.max(initial=0))
        return np.zeros((len(self.lengths), most + 1, width)), np.zeros((len(self.lengths), most // PIECE + 2, width))

    @staticmethod
    def _rescale(sums, logs, block, before):
        """Divide the sums of a block, so far on the scale of the block ``before``, by their greatest."""
        held = sums[:, block * PIECE:(block + 1) * PIECE]
        most = held.max(axis=1)
        most[most == 0] = 1
        held /= most[:, None]
        logs[:, block] = logs[:, before] + np.log(most)

    def forward(self, p):
        """Sums of each prefix, and the logarithms of their scales by block; ``p`` has a row per step of the lattice."""
        sums, logs = self._empty(p.shape[1])
        sums[:, 0] = 1
        for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            if i and i % PIECE == 0:
                self._rescale(sums, logs, i // PIECE, i // PIECE - 1)
            # Steps from one start have different ends, so no place is met twice.
            sums[self.word[a:b], self.end[a:b]] += sums[self.word[a:b], self.start[a:b]] * p[a:b]
        last = len(self.cuts) - 1
        if last and last % PIECE == 0:
            self._rescale(sums, logs, last // PIECE, last // PIECE - 1)
        return sums, logs

    def totals(self, sums, logs):
        """Logarithm of the probability of each word."""
        every = np.arange(len(self.lengths))
        return np.log(sums[every, self.lengths]) + logs[every, self.lengths // PIECE]

    def expected(self, p):
        """Expected uses of each step, over all segmentations weighed by their probability."""
        sums, logs = self.forward(p)
        back, back_logs = self._empty(p.shape[1])
        back[np.arange(len(self.lengths)), self.lengths] = 1
        for i, (a, b) in reversed(list(enumerate(zip(self.cuts[:-1], self.cuts[1:])))):
            np.add.at(back, (self.word[a:b], self.start[a:b]), back[self.word[a:b], self.end[a:b]] * p[a:b])
            if i % PIECE == 0:
                self._rescale(back, back_logs, i // PIECE, i // PIECE + 1)
        scale = logs[self.word, self.start // PIECE] + back_logs[self.word, self.end // PIECE] - self.totals(sums, logs)[self.word]
        return sums[self.word, self.start] * p * back[self.word, self.end] * np.exp(scale)


def _labelled(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")


def fit(docs: DataFrame, pieces: tuple[str, ...], iterations: int = 2, smoothing: float = 0.01) -> Model:
    """Piece probabilities per language from ``(doc_id, text, lang)``.

    Rows without text, id or language are left out; all others are fitted on.
    Their words are counted in Spark; each iteration computes expected piece
    counts of the distinct words by forward and backward sums, in parallel,
    starting from equal probabilities. What comes back to the driver is a number
    per piece and language.
    """
    rows = _labelled(docs)
    # An empty word per text keeps languages whose texts have no letter.
    counts = materialize(rows.select("lang", F.explode(F.split(letters(F.col("text")), " ")).alias("word"))
                         .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "langid-words")
    languages = tuple(sorted(r.lang for r in counts.select("lang").distinct().collect()))
    # The counts take little room and much time: they are dealt to all tasks anew.
    spread = counts.where("word <> ''").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lang", "word")
    index = _Pieces(pieces)
    column = {name: i for i, name in enumerate(languages)}
    uniform = np.full((len(pieces) + 1, len(languages)), 1 / max(1, len(pieces)))
    uniform[-1] = UNKNOWN
    model = Model(pieces, languages, uniform)
    for _ in range(iterations if languages else 0):
        probabilities = model.probabilities

        def expect(batches):
            total = np.zeros_like(probabilities)
            for batch in batches:
                langs, words, counted = (c.to_pylist() for c in batch.columns)
                for block in _in_blocks(words):
                    lattice = _Lattice(["▁" + words[i] for i in block], index)
                    of, weight = np.array([column[langs[i]] for i in block]), np.array([counted[i] for i in block], dtype=float)
                    uses = lattice.expected(probabilities[lattice.piece, of[lattice.word]][:, None])[:, 0] * weight[lattice.word]
                    np.add.at(total, (lattice.piece, of[lattice.word]), uses)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

        uses = spread.select("lang", "word", "n").mapInArrow(expect, "piece bigint, lang bigint, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
        found = np.zeros_like(probabilities)
        # At most the vocabulary times the languages.
        table = uses.toArrow()
        found[table.column("piece").to_numpy(), table.column("lang").to_numpy()] = table.column("uses").to_numpy()
        found = found[:-1] + smoothing
        model = Model(pieces, languages, np.concatenate([found / found.sum(axis=0), np.full((1, len(languages)), UNKNOWN)]))
    return model


class _Scorer:
    """Logarithms of word probabilities per language, kept for words met before; ``cache`` bounds memory only."""

    def __init__(self, model: Model, cache: int = 300_000):
        self.model, self.cache = model, cache
        self.index = _Pieces(model.pieces)
        self.clear()

    def clear(self):
        self.known, self.table, self.size = {}, np.zeros((1 << 14, len(self.model.languages))), 0

    def learn(self, words):
        for block in _in_blocks(words):
            part = [words[i] for i in block]
            lattice = _Lattice(["▁" + word for word in part], self.index)
            rows = lattice.totals(*lattice.forward(self.model.probabilities[lattice.piece]))
            while self.size + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.size:self.size + len(part)] = rows
            self.known.update(zip(part, range(self.size, self.size + len(part))))
            self.size += len(part)

    def scores(self, texts: list[list[str]]) -> list:
        """Log-probability of each text, given as its letter runs, per language; None without any."""
        if len(self.known) > self.cache:
            self.clear()
        get, places = self.known.get, []
        for words in texts:
            places.append(list(map(get, words)))
        missing = {w for words, at in zip(texts, places, strict=True) if None in at for w, p in zip(words, at, strict=True) if p is None}
        if missing:
            self.learn(list(missing))
            places = [list(map(get, words)) if None in at else at for words, at in zip(texts, places, strict=True)]
        return [self.table[at].sum(axis=0) if at else None for at in places]


def predict(docs: DataFrame, model: Model, names=("lang_pred", "score"), evidence: tuple | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the likeliest language and its probability among all.

    ``names`` are the names of these two; columns of ``docs`` that have them are replaced.
    With ``evidence``, three more columns have these names: the logarithm of the
    text's probability in that language, its letters and word marks, its words.

    Languages are equally likely beforehand. A text that is null or has no
    letter gets ``und`` and 0, as has every text if the model knows no
    language. A text's probability is the product over its words; that of a
    word is the sum over all its segmentations into pieces, by a forward pass
    over the whole run of letters, however long. Only ``text`` is used.
    """
    names = (*names, *(evidence or ()))
    columns = [c for c in docs.columns if c not in names]
    inner = docs.toDF(*[f"_d{i}" for i in range(len(docs.columns))])
    place = {c: f"_d{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    kept = [F.col(f"_d{i}") for i, c in enumerate(docs.columns) if c not in names]
    fields = inner.select(*kept).schema
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"] + (["log double", "letters bigint", "words bigint"] if evidence else []))

    model_name = uuid.uuid4().hex

    def classify(batches):
        # The model is told by a name: comparing its numbers would take longer than using them.
        scorer = kept_in_worker(("languages", model_name), lambda: _Scorer(model))
        for batch in batches:
            found, scores, held = [], [], ([], [], [])
            texts = batch.column(batch.num_columns - 1)
            for start in range(0, len(texts), TEXTS_AT_ONCE):
                words = [t.split() for t in texts.slice(start, TEXTS_AT_ONCE).to_pylist()]
                for text, logs in zip(words, scorer.scores(words) if model.languages else [None] * len(words), strict=True):
                    best = 0 if logs is None else int(np.argmax(logs))
                    found.append("und" if logs is None else model.languages[best])
                    scores.append(0.0 if logs is None else float(1 / np.exp(logs - logs[best]).sum()))
                    if evidence:
                        for column, value in zip(held, (0.0 if logs is None else float(logs[best]), sum(map(len, text)) + len(text), len(text)), strict=True):
                            column.append(value)
            more = [pa.array(held[0], pa.float64()), *(pa.array(c, pa.int64()) for c in held[1:])] if evidence else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64()), *more],
                names=[*batch.schema.names[:-1], "lang_pred", "score", *(EVIDENCE if evidence else ())])

    return inner.select(*kept, letters(F.col(place["text"])).alias("_letters")).mapInArrow(classify, schema).toDF(*columns, *names)


def limits(docs: DataFrame, model: Model) -> dict:
    """Per language, and under null for all others: how little evidence clean labelled texts have.

    ``docs`` are labelled rows that the model was not fitted on; all that are found
    in their own language count. A limit is ``(mean, rate, excess)``: the mean
    logarithm per letter over all letters, the least logarithm per letter of a
    text, and the least excess over the mean by the root of the number of words.
    The least logarithm per letter is twice as far below the median as the
    lowest hundredth, or ``SLACK`` times the median where that is lower: mixed
    and repetitive texts of learned languages stay. The least excess is six times
    as far below the median as the lower quartile. Nothing is given where too
    few rows are labelled.
    """
    found = predict(_labelled(docs), model, ("_pred", "_score"), EVIDENCE).where("_pred = lang AND words > 0")
    found = materialize(found.select("lang", *EVIDENCE), "langid-evidence")

    def of(rows, *by):
        means = rows.groupBy(*by).agg((F.sum("log") / F.sum("letters")).alias("mean"), F.count(F.lit(1)).alias("n"))
        # Summed once: the last digits depend on the order of the rows, and both percentiles are told apart by the mean.
        means = materialize(means, "langid-means")
        rows = rows.join(F.broadcast(means), list(by)) if by else rows.crossJoin(F.broadcast(means))  # a row per language
        rows = rows.where(F.col("n") >= LEAST_ROWS).select(
            *by, "mean", (F.col("log") / F.col("letters")).alias("rate"),
            ((F.col("log") - F.col("mean") * F.col("letters")) / F.sqrt("words")).alias("excess"))
        group = (*by, "mean")
        rates = exact_percentiles(rows, "rate", {"low": 0.01, "middle": 0.5}, group).collect()  # a row per language
        excesses = {r[:len(group)]: r for r in exact_percentiles(rows, "excess", {"low": 0.25, "middle": 0.5}, group).collect()}
        for r in rates:
            e = excesses[r[:len(group)]]
            yield r[0] if by else None, (r.mean, min(2 * r.low - r.middle, SLACK * r.middle), 7 * e.low - 6 * e.middle)

    return dict(of(found)) | dict(of(found, "lang"))


def has_evidence(limits: dict, lang: str, log: str, letters: str, words: str) -> Column:
    """Whether a text's evidence reaches the limits of its language: that per letter or, as short texts vary more, the excess."""
    def reaches(mean, rate, excess):
        return (F.col(log) >= rate * F.col(letters)) | (F.col(log) - mean * F.col(letters) >= excess * F.sqrt(words))

    enough = reaches(*limits[None]) if None in limits else F.lit(True)
    for name, limit in limits.items():
        if name is not None:
            enough = F.when(F.col(lang) == name, reaches(*limit)).otherwise(enough)
    return enough


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from the fit: a fixed quarter by the checksum of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
