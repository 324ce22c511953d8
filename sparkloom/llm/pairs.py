"""Broken prompt and response pairs: one defect for each answer that is no proper response.

Languages are compared by the posteriors of a naive Bayes model over character n-grams, fitted on a
bounded sample of documents with a stated language. Refusals are told by a second naive Bayes model over
word n-grams, which labels itself by what the run recorded as abstained. Whether an answer breaks off is
judged by the smoothed likelihood that its last words, or if they are unseen their last characters, end a
sentence anywhere in the answers.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import fold
from sparkloom.runtime import fixed_broadcast, materialize, maybe_broadcast

#: Documents per language that the language model is fitted on, picked by hash. Languages are two letters.
SAMPLE_DOCS = 400
#: Answers recorded as abstained, and as not, that the model of refusals is fitted on, picked by hash.
SAMPLE_ANSWERS = 4000
#: Bins of hashed character n-grams of each language.
NGRAM_BINS = 1 << 15
NGRAMS = (1, 2, 3, 4)
#: Natural logarithm of the odds against the question's language from which an answer is in another one.
ODDS = 6.0
#: Letters of running text that a language is judged on at least.
LETTERS = 12
#: An end is unlikely below this share of the overall likelihood that a word ends a sentence.
END_SHARE = 0.5
#: Weight of the shorter context beside the counts of a longer one, in occurrences.
BACK_OFF = 3.0
#: Occurrences that an ideal refusal or answer stands for, and that an n-gram of refusals needs to count.
IDEAL_WEIGHT, SEEN = 5, 3
#: Log odds against a refusal that a single sentence of one may have.
SENTENCE_ODDS = 2.0

# Placeholders that stand for no answer.
PLACEHOLDERS = frozenset("none null nil nan na n a n/a not available not applicable tbd todo tba empty blank no answer unknown undefined keine aucune aucun ninguna ninguno нет".split()) | {
    "n a", "not available", "not applicable", "no answer", "no response", "to do",
}

# Ideal refusals and ideal answers, beside the sample, so that neither is ever without examples.
DECLINES = [
    "I don't know.", "I do not know the answer.", "I cannot answer this from the extracts.", "The extracts do not say.", "The documents do not mention this.", "There is no information about it in the sources.",
    "Sorry, I am not able to help with this.", "Please consult the full manual.", "This is not covered by the documentation.", "Das weiß ich nicht.", "Die Quellen enthalten keine Antwort.", "Je ne sais pas.",
    "Les extraits ne donnent aucune réponse.", "No lo sé.", "Los documentos no contienen la respuesta.", "Я не знаю ответа.", "В источниках нет ответа.",
]
ANSWERS = [
    "Use the option to list every file in the folder.", "It is kept in the file and read at startup.", "Run the command in the folder, which writes the list.", "The extracts mention the option that lists the files, but it is off by default.", "Yes, you can set it in the manual mode.",
    "The command does not write the file unless it is told to.", "Set the value to 1 and start the program again.", "Die Option schreibt die Datei in den Ordner.", "Der Wert wird beim Start gelesen.", "L'option écrit le fichier dans le dossier.", "La commande lit la valeur au démarrage.",
    "La opción escribe el archivo en la carpeta.", "El programa lee el valor al inicio.", "Программа пишет файл в каталог.", "Значение читается при запуске.",
]
_citation = re.compile(r"\s*\[\s*\d+(?:\s*,\s*\d+)*\s*\]")
_label = re.compile(r"^\W*(?:you asked|your question(?: was| is)?|the question(?: was| is)?|question|asked|q|frage|ihre frage|la question|votre question|pregunta|вопрос)\s*:\s*")
_word = regex.compile(r"[\p{L}\p{N}]+")
_quoted = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"\n]*\"|```.*?```|`[^`]*`", re.S)
_marks = "\"'”“»«)’*_`] \t\r\n"


def clean(text: str | None) -> str:
    """NFKC without format characters, trimmed; case is kept."""
    if not text:
        return ""
    if text.isascii():
        return text.strip()
    return regex.sub(r"\p{Cf}+", "", unicodedata.normalize("NFKC", text)).strip()


def is_empty(answer: str) -> bool:
    ws = _word.findall(_citation.sub("", answer).lower())
    return not ws or " ".join(ws) in PLACEHOLDERS


def without_question(answer: str, question: str) -> str:
    """The answer without an opening line that repeats the question."""
    first, nl, rest = answer.partition("\n")
    if nl and rest.strip() and is_copy(first, question):
        return rest.strip()
    q = question.strip()
    return answer[len(q) :].strip() if q and len(answer) > len(q) + 3 and answer.lower().startswith(q.lower()) else answer


def is_copy(answer: str, question: str) -> bool:
    """The same words as the question but for small changes; a label before it and citations don't count."""
    a = " ".join(_word.findall(_label.sub("", _citation.sub("", answer).lower())))
    q = " ".join(_word.findall(_label.sub("", question.lower())))
    if not a or not q or not 0.6 <= len(a) / len(q) <= 1.5 or len(q) < 4:
        return False
    if a == q:
        return True
    m = SequenceMatcher(None, a, q, autojunk=False)
    if m.real_quick_ratio() < 0.8 or m.quick_ratio() < 0.8:
        return False
    return m.ratio() >= 0.8


def running_text(text: str) -> str:
    """Folded words of running text: without code, quotations, paths, options and names in capitals."""
    text = _citation.sub(" ", _quoted.sub(" ", text))
    kept = [w for w in text.split() if not re.search(r"[/\\~$=_<>{}@#\d]|^-|^[A-Z]{2,}|\w[.:]\w", w)]
    return " ".join(_word.findall(" ".join(kept).lower()))


def ngram_bins(text: str) -> np.ndarray:
    """Bins of the character n-grams of the words, with a blank at both ends of each."""
    out = []
    for w in text.split():
        w = f" {w} "
        out += [w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)]
    return np.fromiter((xxhash.xxh3_64_intdigest(g) % NGRAM_BINS for g in out), np.int64, len(out))


def log_likelihood(counts: np.ndarray) -> np.ndarray:
    """Logarithm of the share of each bin in each row of counts; half an occurrence is added to each bin, in
    proportion to the row's total, so that what no row has is equally likely in all."""
    total = counts.sum(1, keepdims=True)
    more = 0.5 * total / max(1.0, float(total.mean())) + 1e-9
    return np.log((counts + more) / (counts + more).sum(1, keepdims=True))


class Languages:
    """Naive Bayes over hashed character n-grams."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.log = log_likelihood(counts) if len(names) else np.zeros((0, NGRAM_BINS))
        self.seen: dict[str, np.ndarray] = {}

    def scores(self, text: str) -> np.ndarray:
        """Log-likelihood of each language, a word counting by the average of its n-grams of each length."""
        total = np.zeros(len(self.names))
        for w in text.split():
            s = self.seen.get(w)
            if s is None:
                b = ngram_bins(w)
                s = self.log[:, b].sum(1) / len(NGRAMS)
                if len(self.seen) > 200_000:
                    self.seen.clear()
                self.seen[w] = s
            total = total + s
        return total

    def differ(self, question: str, answer: str) -> bool:
        """The answer's language is surely not the question's."""
        if len(self.names) < 2:
            return False
        a, q = running_text(answer), running_text(question)
        known = set(q.split())
        a = " ".join(w for w in a.split() if w not in known)
        if sum(map(len, a.split())) < LETTERS or len(a.split()) < 3 or sum(map(len, q.split())) < LETTERS:
            return False
        sa, sq = self.scores(a), self.scores(q)
        x = int(np.argmax(sa))
        # posterior of the question: the answer differs if its language is unlikely for the question and the other way round
        y = int(np.argmax(sq))
        return x != y and sa[x] - sa[y] > ODDS and sq[y] - sq[x] > 0.5 * ODDS


def _sampled(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Of (key, by) the ``most`` rows of each value of ``by`` (few values) with the least hash of the key.

    Values are counted first, and only rows below the hash that some 1.5 times ``most`` rows are expected
    under are ranked, so that no value is ranked as a whole.
    """
    n = rows.groupBy(by).agg(F.count("*").alias("_n"))
    u = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 1).cast("double") / float(1 << 63)
    low = rows.join(fixed_broadcast(n, 26 * 26), by).withColumn("_u", u).where(F.col("_u") * F.col("_n") < 1.5 * most + 50)
    return low.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy("_u", key))).where(F.col("_k") <= most).select(key, by)


def fit_languages(documents: DataFrame, per_language: int = SAMPLE_DOCS) -> Languages:
    """Fitted on the ``per_language`` documents of each stated language that have the least hash of doc_id.

    Stated languages are trimmed, lower-cased and cut to two letters a to z; others are left out. n-gram
    counts are added up on the executors; one row of fixed size for each language comes to the driver.
    """
    lang = F.substring(F.lower(F.trim("lang")), 1, 2)
    rows = documents.select("doc_id", lang.alias("lang")).where(F.col("lang").rlike("^[a-z]{2}$") & F.col("doc_id").isNotNull()).distinct()
    picked = materialize(_sampled(rows, "lang", "doc_id", per_language), "sample")
    texts = documents.select("doc_id", "text").where("text is not null").join(maybe_broadcast(picked, 32), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                mine = sums.setdefault(name, np.zeros(NGRAM_BINS, np.int64))
                mine += np.bincount(ngram_bins(running_text(clean(text))), minlength=NGRAM_BINS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "blob": pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())})

    def add(pdf):
        return pdf.iloc[:1].assign(blob=[zlib.compress(sum(np.frombuffer(zlib.decompress(b), np.int64) for b in pdf["blob"]).tobytes(), 1)])

    got = texts.select("lang", "text").mapInArrow(count, "lang string, blob binary").groupBy("lang").applyInPandas(add, "lang string, blob binary").collect()
    got = sorted(((r["lang"], np.frombuffer(zlib.decompress(r["blob"]), np.int64)) for r in got), key=lambda x: x[0])
    return Languages([n for n, _ in got], np.array([c for _, c in got]).reshape(len(got), NGRAM_BINS).astype(float))


_stop = re.compile(r"[.!?\n]+(?=\s|$)")
_piece = re.compile(r"[^\W\d_][\w'\-]*|\S")


def refusal_bins(question: str, answer: str) -> list[np.ndarray]:
    """For each sentence of an answer, bins of its n-grams of one to three words and marks; quotations, code and words of the question are one symbol."""
    known = set(_piece.findall(fold(question).replace("’", "'")))
    text = _quoted.sub(" # ", _citation.sub("", fold(answer)).replace("’", "'"))
    out = []
    for s in _stop.split(text):
        ws = ["#" if w in known and w[0].isalpha() else w for w in _piece.findall(s)]
        if any(w[0].isalnum() or w == "#" for w in ws):
            ws = ["^", *ws, "$"]
            grams = ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])] + [f"{x} {y} {z}" for x, y, z in zip(ws, ws[1:], ws[2:])]
            out.append(np.fromiter((xxhash.xxh3_64_intdigest(g) % NGRAM_BINS for g in grams), np.int64, len(grams)))
    return out


class Refusals:
    """Naive Bayes over hashed word n-grams of sentences: refusals against answers."""

    def __init__(self, counts: np.ndarray):
        """counts: of answers and of refusals, by bin; the ideal ones are added."""
        counts = counts.astype(float)
        for k, texts in enumerate((ANSWERS, DECLINES)):
            for t in texts:
                counts[k] += IDEAL_WEIGHT * np.bincount(np.concatenate(refusal_bins("", t)), minlength=NGRAM_BINS)
        log = log_likelihood(counts)
        # the record is wrong at times: what one or two answers have tells nothing
        self.odds = np.where(counts.sum(0) >= SEEN, log[1] - log[0], 0.0)

    def declines(self, question: str, answer: str) -> bool:
        """The answer as a whole is surely a refusal, and none of its sentences is likely an answer."""
        odds = [float(self.odds[b].sum()) for b in refusal_bins(question, answer)]
        return bool(odds) and sum(odds) > ODDS and min(odds) > -SENTENCE_ODDS


def fit_refusals(rows: DataFrame, most: int = SAMPLE_ANSWERS) -> Refusals:
    """Fitted on ``most`` answers recorded as abstained and as many recorded as not, of (key, question, answer, abstained).

    Empty answers and copies of the question are left out. The record need not be right for each answer.
    """
    picked = _sampled(rows.where("abstained is not null and answer is not null").select("key", "abstained"), "abstained", "key", most)
    texts = rows.select("key", "question", "answer").join(maybe_broadcast(materialize(picked, "declined"), 32), "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, NGRAM_BINS), np.int64)
        for b in batches:
            for q, a, k in zip(*(b[c].to_pylist() for c in ("question", "answer", "abstained"))):
                q, a = clean(q), clean(a)
                rest = without_question(a, q)
                if not is_empty(rest) and not (q and is_copy(rest, q)):
                    for x in refusal_bins(q, rest):
                        sums[int(k)] += np.bincount(x, minlength=NGRAM_BINS)
        yield pa.RecordBatch.from_pydict({"one": pa.array([1], pa.int32()), "blob": pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())})

    def add(pdf):
        return pdf.iloc[:1].assign(blob=[zlib.compress(sum(np.frombuffer(zlib.decompress(b), np.int64) for b in pdf["blob"]).tobytes(), 1)])

    got = texts.select("question", "answer", "abstained").mapInArrow(count, "one int, blob binary").groupBy("one").applyInPandas(add, "one int, blob binary").collect()
    return Refusals(np.frombuffer(zlib.decompress(got[0]["blob"]), np.int64).reshape(2, -1) if got else np.zeros((2, NGRAM_BINS)))


def _tokens(answer: str) -> list[tuple[str, bool]]:
    """Folded tokens, and whether each ends a sentence: by a mark, a citation or the end of a line. The last of the text counts only with a mark or citation."""
    out: list[tuple[str, bool]] = []
    lines = clean(answer).split("\n")
    for k, line in enumerate(lines):
        got = []
        for w in re.sub(r"\[\s*\d+\s*\]", " \x00 ", line).split():
            if w == "\x00" or not w.strip(".!?…"):
                if got:
                    got[-1] = (got[-1][0], True)
                continue
            bare = w.rstrip(_marks)
            ended = bare.endswith((".", "!", "?", "…"))
            got.append((bare.rstrip(".!?…").lower(), ended))
        if got and k < len(lines) - 1:
            got[-1] = (got[-1][0], True)
        out += got
    return out


def breaks_off_openly(answer: str) -> bool:
    """The end leaves a bracket, quotation or code open, or stands at a mark that needs a sequel."""
    text = clean(answer)
    body = re.sub(r"\[\s*\d+\s*\]", "", text).rstrip()
    if not body:
        return False
    opened = body.count("“") > body.count("”") if "„" not in body else body.count("„") > body.count("“") + body.count("”")
    if opened or body.count("`") % 2 or body.count("(") > body.count(")") or body.count("[") > body.count("]") or body.count("«") > body.count("»"):
        return True
    return body[-1] in ",;:-–(/=&+" or body.endswith(("--", "…", "..."))


def is_closed(answer: str) -> bool:
    """The text ends with a citation or a full stop, question or exclamation mark."""
    return bool(re.search(r"(?:\[\s*\d+\s*\]|[.!?。])[\s\"'”“»)*_`]*$", clean(answer)))


def _suffix(word: str) -> str:
    return f"^{word}"[-3:]


class EndCounts:
    """How often contexts occur, and end a sentence (``chars``: a word)."""

    def __init__(self):
        self.n: dict[str, Counter] = {k: Counter() for k in ("pair", "word", "suffix", "chars", "all")}
        self.ends: dict[str, Counter] = {k: Counter() for k in self.n}

    def add(self, answer: str) -> None:
        toks = _tokens(answer)
        if toks and not is_closed(answer):
            toks = toks[:-1]  # whether this one is an end is the question
        prev = ""
        for w, end in toks:
            for kind, c in (("word", w), ("pair", f"{prev} {w}")):
                self.n[kind][c] += 1
                if end:
                    self.ends[kind][c] += 1
            prev = "" if end else w

    def rows(self) -> pa.RecordBatch:
        """(kind, context, n, ends) of all, which are forgotten."""
        for w, n in self.n["word"].items():
            ends = self.ends["word"][w]
            for kind, c in (("suffix", _suffix(w)), ("all", "")):
                self.n[kind][c] += n
                self.ends[kind][c] += ends
            for i in range(1, len(w) + 1):
                self.n["chars"][_suffix(w[:i])] += n
            self.ends["chars"][_suffix(w)] += n
        flat = [(k, c, n, self.ends[k][c]) for k, found in self.n.items() for c, n in found.items()]
        self.__init__()
        kind, c, n, ends = zip(*flat) if flat else ((),) * 4
        return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.string()), "context": pa.array(c, pa.string()), "n": pa.array(n, pa.int64()), "ends": pa.array(ends, pa.int64())})


def end_likelihood(c: dict) -> Column:
    """Likelihood of an end from columns (n, ends) by kind, each context backed off to the shorter one: pair, word, characters, all."""
    n, e = (lambda k: F.coalesce(c[k][0], F.lit(0))), (lambda k: F.coalesce(c[k][1], F.lit(0)))
    smooth = lambda k, shorter: (e(k) + BACK_OFF * shorter) / (n(k) + BACK_OFF)
    unseen = smooth("suffix", e("all") / F.greatest(n("all"), F.lit(1))) * smooth("chars", F.lit(0.1))
    return smooth("pair", smooth("word", unseen))


def defective_pairs(answers: DataFrame, documents: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, defect) for each answer with a defect: empty, truncated, refusal, copy or language.

    Needs the columns question, answer, kind and abstained. Null and blank answers are empty. A null
    question can be neither copied nor of another language; only kind 'answerable' makes a refusal a
    defect. Tests go in the order empty, copy, refusal, language, truncated, and the first that holds is
    given. Repeated rows count once (of several answers under one key, the least). Null keys are left out.
    """
    spark = answers.sparkSession
    rows = answers.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct("question", "answer", "kind", "abstained")).alias("r")).select("key", "r.*")
    rows = materialize(rows, "answers")
    model = spark.sparkContext.broadcast((fit_languages(documents), fit_refusals(rows)))
    key_type = _arrow_of(answers, key)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass: defects and open ends of answers, and counts of ends."""
        languages, refusals = model.value
        counts = EndCounts()

        def counted() -> pa.RecordBatch:
            got = counts.rows()
            none = lambda t: pa.nulls(got.num_rows, t)
            return pa.RecordBatch.from_pydict({"key": none(key_type), "defect": none(pa.string()), "last": none(pa.string()), "before": none(pa.string())} | {c: got[c] for c in ("kind", "context", "n", "ends")})

        for b in batches:
            out = []
            for q, a, k in zip(b["question"].to_pylist(), b["answer"].to_pylist(), b["kind"].to_pylist()):
                out.append(judge_pair(q, a, k, languages, refusals))
                if a:
                    counts.add(a)
            keep = [i for i, x in enumerate(out) if x]
            none = lambda t: pa.nulls(len(keep), t)
            one = lambda j: pa.array([out[i][j] for i in keep], pa.string())
            yield pa.RecordBatch.from_pydict({"key": b["key"].take(pa.array(keep, pa.int64())), "defect": one(0), "before": one(1), "last": one(2), "kind": none(pa.string()), "context": none(pa.string()), "n": none(pa.int64()), "ends": none(pa.int64())}).select(["key", "defect", "last", "before", "kind", "context", "n", "ends"])
            if len(counts.n["pair"]) > 300_000:
                yield counted()
        yield counted()

    kind = dict(answers.dtypes)[key]
    judged = materialize(rows.select("key", "question", "answer", "kind").mapInArrow(judge, f"key {kind}, defect string, last string, before string, kind string, context string, n long, ends long"), "judged")
    suffix = F.substring(F.concat(F.lit("^"), "last"), -3, 3)
    asked = {"pair": F.concat_ws(" ", "before", "last"), "word": F.col("last"), "suffix": suffix, "chars": suffix, "all": F.lit("")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("context")) for k, c in asked.items()]))
    open_ends = materialize(judged.where("kind is null and defect is null").select("key", each.alias("c")).select("key", "c.kind", "c.context"), "open")
    # only contexts that some open answer asks for are added up
    ends = judged.where("kind is not null").join(open_ends.select("kind", "context").distinct(), ["kind", "context"], "left_semi").groupBy("kind", "context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    found = open_ends.join(ends, ["kind", "context"]).groupBy("key").agg(*[F.max(F.when(F.col("kind") == k, F.col(x))).alias(f"{k}_{x}") for k in asked for x in ("n", "ends")])
    likely = end_likelihood({k: (F.col(f"{k}_n"), F.col(f"{k}_ends")) for k in asked})
    cut = found.where(likely < END_SHARE * F.col("all_ends") / F.greatest(F.col("all_n"), F.lit(1))).select("key", F.lit("truncated").alias("defect"))
    # an answer with nothing to compare it with ends as it ends
    return judged.where("kind is null and defect is not null").select("key", "defect").union(cut).withColumnRenamed("key", key)


def _arrow_of(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def judge_pair(question: str | None, answer: str | None, kind: str | None, languages: Languages, refusals: Refusals) -> tuple[str | None, str | None, str | None] | None:
    """(defect, None, None); or (None, word before the last, last word) if the end must be looked up; or None."""
    a, q = clean(answer), clean(question)
    if is_empty(a):
        return "empty", None, None
    if q and is_copy(a, q):
        return "copy", None, None
    rest = without_question(a, q)
    if is_empty(rest) or q and is_copy(rest, q):
        return "copy", None, None
    if refusals.declines(q, rest):
        return ("refusal", None, None) if kind == "answerable" else None
    if q and languages.differ(q, rest):
        return "language", None, None
    if is_closed(a):
        return None
    if breaks_off_openly(a):
        return "truncated", None, None
    if re.match(r"(?: {4}|\t)\s*\S", a.rpartition("\n")[2]):
        return None  # a line of code has no full stop
    toks = _tokens(a)
    if not toks:
        return None
    return None, toks[-2][0] if len(toks) > 1 and not toks[-2][1] else "", toks[-1][0]
