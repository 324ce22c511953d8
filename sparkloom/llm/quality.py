"""Text quality statistics of each document, and whether it is prose, a list, a table or junk.

Each text is described by distributions: of its function words, of pairs of character classes, of the
shapes of its words, and of the shapes of its lines by their visible characters. Their Jensen-Shannon divergences
from structural profiles (prose of each language, and several kinds of lists, tables and junk), which a
labelled sample gives, are the only thing that the form is decided by: the nearest form in the space of
divergences, measured in the spread that the sample has within its forms.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import mix, words
from sparkloom.runtime import fixed_broadcast, materialize

#: Labelled documents that the profiles are fitted on at most, picked by hash.
SAMPLE_LABELS = 4000
#: Profiles of a form that is no prose at most, and labelled documents a profile has about at least.
KINDS, KIND_DOCS = 10, 15
#: Characters measured at a time; a longer text is measured in pieces whose counts are added up.
SLICE = 500_000
FORMS = ("prose", "list", "table", "junk")

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for with without from into as is are was were be been has have had do does not no this that these those it its if when then than which who what how only both each every before after during unless until so than too also may can must should there they them their you your one some other others under up again whenever while because".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht kein keine in im an am auf aus bei mit nach von vom zu zum zur für über unter vor durch ohne um ist sind war wird werden wurde hat haben kann können muss soll es sie er wir ihr sich wenn dass ob so wie als auch nur noch schon jede jeder jedes bevor danach beim jederzeit".split(),
    "fr": "le la les l un une des du de d et ou mais ne pas dans sur sous par pour avec sans à au aux en est sont été être a ont peut peuvent doit il elle ils on ce cette ces cet son sa ses leur si que qui quoi quand comme plus puis avant après depuis chaque tout toute toujours jamais lorsque même".split(),
    "es": "el la los las lo un una unos unas y o pero no en de del al a por para con sin sobre bajo entre es son fue ser ha han puede pueden debe se su sus que quien cuando como más muy antes después desde hasta cada todo toda siempre nunca si este esta estos ese esa luego tiene también".split(),
    "ru": "и в во не на с со а но или что как это то за из от до по для о об при через без под над если когда который которая которые его её их он она они мы вы же бы был была были есть уже ещё только все всё каждый каждом этот эта сначала затем прежде чем может".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)

# Character classes by their members; letters, digits, blanks and the rest go by their Unicode properties.
VOWEL, SMALL, CAPITAL, LETTER, DIGIT, BLANK, LINE_END, TAB, SYMBOL, BROKEN = 0, 1, 2, 3, 4, 5, 6, 7, 22, 23
MARKS = {
    8: ".…。!?", 9: ",", 10: ";:", 11: "\"'`“”„«»‘’", 12: "()[]{}", 13: "<>", 14: "-–—", 15: "/\\", 16: "_", 17: "|", 18: "=+", 19: "&#%@", 20: "*•·‣◦▪→", 21: "^~$",
}
VOWELS = "aeiouyаеиоуыэюяё"
CLOSING = ".!?:;,…。)\"'”»`"
LINE_ENDS = "\n\r\x0b\x0c\x85\u2028\u2029"
CLASSES = 24

#: Bins of the views: pairs of character classes, word shapes, line shapes, function words of all languages.
_LINES = 7 * 5 * 4 * 4 * 4 * 2
_vocabulary = sorted(set().union(*FUNCTION_WORDS.values()))
VIEWS = {"pairs": CLASSES * CLASSES, "words": 211, "lines": _LINES, "function": len(_vocabulary)}

# Ideal texts: one labelled document each, beside the sample, so that no form is ever without a profile.
IDEAL = [
    ("prose", "The program reads the file that you name and writes it to the output. If there is no such file, it stops with an error, which you can see in the log. This is not what most users want, so you should name a folder as well."),
    ("prose", "Das Programm liest die Datei, die Sie nennen, und schreibt sie in die Ausgabe. Wenn es die Datei nicht gibt, bricht es mit einem Fehler ab, der auch im Protokoll steht. Das ist nicht immer gewollt."),
    ("prose", "Le programme lit le fichier que vous donnez et l'écrit dans la sortie. Si le fichier n'est pas là, il s'arrête avec une erreur qui est aussi dans le journal. Ce n'est pas toujours ce que vous voulez."),
    ("prose", "El programa lee el archivo que se le da y lo escribe en la salida. Si no hay archivo, se para con un error que también se puede ver en el registro. Esto no es lo que la mayoría quiere."),
    ("prose", "Программа читает файл, который вы назвали, и пишет его в вывод. Если такого файла нет, она завершается с ошибкой, которая есть и в журнале. Это не всегда то, что нужно."),
    ("prose", "SUMMARY\nEvery line that is read goes to the log before the next one is, and nothing is lost when the power\nfails. The user may then start again from the last line that was written, which is what most of them do."),
    ("prose", "some servers stop when a client has gone away\nwhile others wait until it comes back\nand there is no way to tell them apart"),
    ("prose", "You may stop here."),
    ("prose", "It was the last one.\nNone of them is left"),
    ("prose", "The dog ran.\nThen it stopped at the door."),
    ("list", "/usr/share/doc\n/etc/hosts\n~/.bashrc\n/opt/tool/bin\n/var/log"),
    ("list", "grep(1), awk(1), sed(1), find(1), sort(1p), printf(3)"),
    ("list", "server\n    answers requests\nclient\n    sends requests\nproxy\n    passes requests"),
    ("list", "The options are:\n[x] build tree,\n[ ] test tree;\n[x] pack tree"),
    ("list", "- open file\n- save file\n- close window\n- print page\n- quit program\n- undo change"),
    ("list", "1. Install package\n2. Start service\n3. Check status\n4. Restart machine\n5. Read log"),
    ("list", "-a, --all    show all\n-v, --verbose    more output\n-q, --quiet    less output\n-h, --help    show help"),
    ("list", "C-x C-f  find-file\nC-x C-s  save-buffer\nC-x C-c  exit\nM-x  command\nC-g  quit"),
    ("table", "| name | size | date |\n|------|------|------|\n| a.txt | 120 | 2020 |\n| b.txt | 3400 | 2021 |\n| c.txt | 7 | 2022 |"),
    ("table", "name\tsize\tdate\na.txt\t120\t2020\nb.txt\t3400\t2021\nc.txt\t7\t2022"),
    ("table", "name,size,date\na.txt,120,2020\nb.txt,3400,2021\nc.txt,7,2022"),
    ("table", "NAME      SIZE    DATE\na.txt     120     2020\nb.txt     3400    2021\nc.txt     7       2022"),
    ("table", "x;y;z\n1;2;3\n4;-;6\n7;8;no"),
    ("table", "k,v\nred,1,a\nblue,2,b\ngreen,3,c"),
    ("table", "| K | V |\n|---|---|\n| x | no |\n| z | 5 |"),
    ("table", "+-----+-----+\n| key | val |\n+-----+-----+\n| one | 1   |\n| two | 2   |\n+-----+-----+"),
    ("table", "   77     8    910\n    3    14     15\n  926     5    358"),
    ("table", "<table>\n<tr><th>Key</th><th>Value</th></tr>\n<tr><td>one</td><td>1</td></tr>\n<tr><td>two</td><td>2</td></tr>\n</table>"),
    ("junk", ".SH \\fBx\\-\\|1\\&\\{\n.nr \\fI\\-\\|2\\&\\}\n.if \\n(.g .ds T< \\\\FC"),
    ("junk", "wkqyemrtv bjzuxpd nqwvak ytrfgzho lmxcvie dqpwz sjkbrunx"),
    ("junk", "ozrkvwq htbxyj lpwmgqe vcnkszu qxfdra jgbtwyhk mzrpl"),
    ("junk", "what! what! what! what! what! what! what! what! what! what!"),
    ("junk", "gkqwvjx hrtzpl wdfkqjx bnmtrw zzkqvx plkjhtr qwrtpsdf ghjklzxc"),
    ("junk", "$$ ?? <> ;; }{ || @# !! %% ^^ ~~ && 0x7f __ ::"),
    ("junk", "aGVsbG8gd29ybGQhIHRoaXMgaXMgYmFzZTY0IGVuY29kZWQgdGV4dCB0aGF0IG5vYm9keSBjYW4gcmVhZA==\nU29tZSBtb3JlIG9mIGl0IGhlcmUgYXMgd2VsbCwgYW5kIG9uIGFuZCBvbg=="),
    ("junk", "xqzt vbnk wrpl qqxz jkdf zxcv bnmq wrtp lkjh gfds zzxq vvbk"),
    ("junk", "=====*****#####-----=====*****#####-----\n%%%%%@@@@@!!!!!~~~~~^^^^^\n&&&&&+++++=====_____"),
    ("junk", "<div><span></span></div>\n<td></td><br/>&nbsp;&nbsp;<p></p>\n</div></div><hr/>"),
    ("junk", "4f 2a 00 ff 13 9c e0 7b 4f 2a 00 ff\n13 9c e0 7b aa 0d 55 12 9f c3 d1 08"),
]


def char_class(c: str) -> int:
    """Class of one character."""
    if "\ud800" <= c < "\ue000":
        return BROKEN
    if c.isalpha():
        base = unicodedata.normalize("NFD", c)[0]
        return CAPITAL if c.isupper() else LETTER if not c.islower() else VOWEL if base in VOWELS else SMALL
    if c.isnumeric():
        return DIGIT
    if c in LINE_ENDS:
        return LINE_END
    if c.isspace():
        return TAB if c == "\t" else BLANK
    for k, members in MARKS.items():
        if c in members:
            return k
    if unicodedata.combining(c):
        return VOWEL
    return BROKEN if c == "\ufffd" or not c.isprintable() else SYMBOL


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Class and hash by code point (the hash is that of the small letter), function words by hash, and languages by function word."""
    chars = [chr(i) for i in range(1 << 16)]
    small = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(63, 0x9E3779B97F4A7C15, np.uint64)], dtype=np.uint64)
        at = mix(small + np.uint64(77))
        own = np.array([np.sum(at[[ord(c) for c in w]] * power[: len(w)], dtype=np.uint64) for w in _vocabulary], np.uint64)
    order = np.argsort(own)
    member = np.array([[w in FUNCTION_WORDS[k] for w in _vocabulary] for k in LANGUAGES])
    closing = np.zeros(1 << 16, bool)
    closing[[ord(c) for c in CLOSING]] = True
    return {"cls": np.array([char_class(c) for c in chars], np.uint8), "hash": at, "raw": mix(np.arange(1 << 16, dtype=np.uint64)), "power": power, "word": own[order], "of": order, "member": member, "closing": closing}


class Measures:
    """Counts of the views of some texts as sparse rows, with what the statistics need."""

    def __init__(self, n: int):
        self.n = n
        self.found: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {v: [] for v in VIEWS}
        self.lang = np.full(n, -1)
        self.words, self.word_chars, self.common, self.lines, self.closed = (np.zeros(n, np.int64) for _ in range(5))
        self.visible, self.symbols = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def view(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bin, count) of a view, by row."""
        if not self.found[name]:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        r, c, k = (np.concatenate(x) for x in zip(*self.found[name]))
        code, which = np.unique(r * VIEWS[name] + c, return_inverse=True)
        return code // VIEWS[name], code % VIEWS[name], np.bincount(which.reshape(-1), k, len(code))


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(row, text or piece of it), together of about SLICE characters at a time."""
    held, size = [], 0
    for row, t in enumerate(texts):
        t = t.replace("\r\n", "\n")
        a = 0
        while a < len(t):
            # at a line end where there is one
            b = t.rfind("\n", a, a + SLICE) + 1 if a + SLICE < len(t) else len(t)
            b = b or a + SLICE
            held.append((row, t[a:b] if t[b - 1] == "\n" else t[a:b] + "\n"))
            a = b
            size += len(held[-1][1])
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def measure(texts: list[str]) -> Measures:
    """Views and counts of texts; a blank text has none."""
    out = Measures(len(texts))
    plain = np.array([t.isascii() and len(t) <= SLICE for t in texts], bool)
    for held in _pieces(texts):
        _measure(held, out)
    # the words of other texts are those of their Unicode form NFKC; a text in pieces could have a word cut
    for i in np.flatnonzero(~plain).tolist():
        ws = words(texts[i])
        out.words[i], out.word_chars[i] = len(ws), sum(map(len, ws))
    return out


def _counted(rows: np.ndarray, bins: np.ndarray, width: int, n: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if weights is None and width * n < 4 * len(bins) + 4_000_000:
        k = np.bincount(rows * width + bins, minlength=1)
        code = np.flatnonzero(k)
        return code // width, code % width, k[code].astype(float)
    code, which = np.unique(rows * width + bins, return_inverse=True)
    return code // width, code % width, np.bincount(which.reshape(-1), weights, len(code)).astype(float)


def _measure(held: list[tuple[int, str]], out: Measures) -> None:
    t = _tables()
    at = np.array([r for r, _ in held])
    n = len(held)
    cps = np.frombuffer("".join([x for _, x in held]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(n), [len(x) for _, x in held])
    low = np.minimum(cps, 0xFFFF)
    cls = t["cls"][low]
    for c in np.unique(cps[cps > 0xFFFF]).tolist():
        cls[cps == c] = char_class(chr(c))

    def before(x: np.ndarray) -> np.ndarray:
        """Sums of x before each place, so that a span's sum is a difference."""
        return np.concatenate([np.zeros(1, np.uint64 if x.dtype == np.uint64 else np.int64), np.cumsum(x, dtype=np.uint64 if x.dtype == np.uint64 else np.int64)])

    def add(view: str, rows: np.ndarray, bins: np.ndarray, weights: np.ndarray | None = None) -> None:
        if len(bins):
            r, c, k = _counted(rows.astype(np.int64), bins.astype(np.int64), VIEWS[view], n, weights)
            out.found[view].append((at[r], c, k))

    add("pairs", doc[:-1], cls[:-1].astype(np.int32) * CLASSES + cls[1:])
    blank = (cls >= BLANK) & (cls <= TAB)
    np.add.at(out.visible, at, np.bincount(doc[~blank], minlength=n))
    np.add.at(out.symbols, at, np.bincount(doc[~blank & (cls > DIGIT)], minlength=n))

    # words: runs of letters and digits, hashed
    inside = cls <= DIGIT
    start, end = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]), np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    size, wdoc = end - start, doc[start]
    place = np.minimum(np.arange(len(cps))[inside] - np.repeat(start, size), 63)
    hashes = np.zeros(len(cps), np.uint64)
    with np.errstate(over="ignore"):
        hashes[inside] = t["hash"][low[inside]] * t["power"][place]
        sums = before(hashes)
        of_word = sums[end] - sums[start]
    k = np.minimum(np.searchsorted(t["word"], of_word), len(t["word"]) - 1)
    known = t["word"][k] == of_word
    word = t["of"][k]
    dense = np.bincount(wdoc[known] * len(_vocabulary) + word[known], minlength=n * len(_vocabulary)).reshape(n, -1)
    per = dense @ t["member"].T
    lang = np.where(per.max(1) > 0, per.argmax(1), -1)
    mine = (t["member"][lang[wdoc], word] & known & (lang[wdoc] >= 0)) if len(wdoc) else np.zeros(0, bool)
    add("function", wdoc[mine], word[mine])
    # a text in pieces has the language of its first one that has any
    fresh = (out.lang[at] < 0) & (lang >= 0)
    out.lang[at[fresh][::-1]] = lang[fresh][::-1]
    for total, x in ((out.words, None), (out.word_chars, size), (out.common, mine)):
        np.add.at(total, at, np.bincount(wdoc, x, minlength=n).astype(np.int64))

    # shapes of words: own function word, or kind, length and share of vowels
    glued = ((cls[np.maximum(start - 1, 0)] >= 12) & (start > 0)) | ((cls[end] >= 13) & (cls[end] != 14))
    own = mine & ~glued
    digits, capitals, vowels = (before(x)[end] - before(x)[start] for x in (cls == DIGIT, cls == CAPITAL, cls == VOWEL))
    kind = np.select([digits == size, digits > 0, capitals == size, (capitals == 1) & (cls[start] == CAPITAL), capitals > 0, glued], [0, 1, 2, 3, 4, 5], 6)
    of_vowels = np.where((digits == 0) & (size >= 4), np.searchsorted([0.2, 0.33, 0.5], vowels / np.maximum(size, 1), "right"), 4)
    add("words", wdoc, np.where(own, 0, 1 + kind * 30 + np.searchsorted([2, 4, 7, 12, 20], size, "right") * 5 + of_vowels))

    # shapes of lines, by visible characters
    stop = np.flatnonzero(cls == LINE_END)
    begin = np.r_[0, stop[:-1] + 1]
    seen = before(~blank)
    weight = seen[stop] - seen[begin]
    begin, stop, weight = (x[weight > 0] for x in (begin, stop, weight))
    if not len(begin):
        return
    ldoc = doc[begin]
    visible = np.flatnonzero(~blank)
    first, last = visible[np.searchsorted(visible, begin)], visible[np.searchsorted(visible, stop) - 1]
    np.add.at(out.lines, at, np.bincount(ldoc, minlength=n))
    np.add.at(out.closed, at, np.bincount(ldoc[t["closing"][low[last]]], minlength=n))
    a, b = np.searchsorted(start, begin), np.searchsorted(start, stop)
    own_before = before(own)
    tokens = before(~blank & np.r_[True, blank[:-1]])
    n_tokens = tokens[stop] - tokens[begin]
    share = np.searchsorted([0.001, 0.12, 0.25], (own_before[b] - own_before[a]) / np.maximum(n_tokens, 1), "right")
    mark = (cls >= 9) & (cls != 11)
    marks = before(mark)
    n_marks = marks[stop] - marks[begin]
    with np.errstate(over="ignore"):
        sums = before(np.where(mark, t["raw"][low], np.uint64(0)))
        signature = sums[stop] - sums[begin]
    gap = np.r_[False, (cls[1:] == BLANK) & (cls[:-1] == BLANK)] | (cls == TAB)
    gaps = before(gap & ~np.r_[False, gap[:-1]])
    n_gaps = gaps[stop] - gaps[first]
    # lines with the marks of the line before or behind them are rows
    same = np.r_[False, (signature[1:] == signature[:-1]) & (ldoc[1:] == ldoc[:-1])]
    same |= np.r_[same[1:], False]
    row = np.select([same & (n_marks >= 2), n_gaps >= 2, same & (n_marks == 1)], [2, 3, 1], 0)
    second, third = (cls[np.minimum(first + k, len(cls) - 1)] for k in (1, 2))
    c = cls[first]
    bullet = np.isin(c, (12, 14, 20)) & (second == BLANK) | (c <= DIGIT) & np.isin(second, (8, 12)) & (third == BLANK) | (c == DIGIT) & (second == DIGIT) & np.isin(third, (8, 12)) | (c == 12) & (third == 12)
    head = np.where(bullet, 6, np.array([0, 0, 1, 0, 2, 0, 0, 0, 3, 3, 3, 3, 4, 4, 4, 5, 5, 4, 5, 5, 4, 5, 5, 5])[c])
    tail = np.array([0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 2, 1, 3, 3, 2, 4, 4, 4, 4, 4, 4, 4, 4, 4])[cls[last]]
    long = np.searchsorted([2, 4, 8], n_tokens, "right")
    add("lines", ldoc, ((((head * 5 + tail) * 4 + share) * 4 + long) * 4 + row) * 2 + (begin != first), weight.astype(float))


def divergences(rows: np.ndarray, bins: np.ndarray, counts: np.ndarray, n: int, profiles: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each of ``n`` sparse rows from each profile (rows that sum to 1); 1 for an empty row."""
    total = np.bincount(rows, counts, n)
    out = np.ones((n, len(profiles)))
    if not len(rows):
        return out
    p = (counts / total[rows]).astype(np.float32)[:, None]
    q = profiles.T.astype(np.float32)[bins]
    with np.errstate(divide="ignore", invalid="ignore"):
        term = p * np.log2(p) + np.where(q > 0, q * np.log2(q), np.float32(0)) - (p + q) * np.log2((p + q) / 2) - q
    some, first = np.unique(rows, return_index=True)
    # what only the profile has adds its share
    out[some] = np.clip((np.add.reduceat(term, first, axis=0, dtype=np.float64) + profiles.sum(1)) / 2, 0, 1)
    return out


def _clusters(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Cluster of each row: the farthest rows start, means follow."""
    start = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    far = ((x - x[start[0]]) ** 2).sum(1)
    while len(start) < k:
        start.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[start[-1]]) ** 2).sum(1))
    means = x[start]
    for _ in range(rounds):
        near = ((means**2).sum(1) - 2 * x @ means.T).argmin(1)
        means = np.array([x[near == j].mean(0) if (near == j).any() else means[j] for j in range(k)])
    return near


class Profiles:
    """Structural profiles, and the place and spread of the four forms in the space of divergences from them."""

    def __init__(self, measures: Measures, forms: np.ndarray):
        """measures of labelled texts, and the number of each one's form; the ideal texts are added."""
        ideal = measure([x for _, x in IDEAL])
        n = measures.n
        form = np.concatenate([forms, [FORMS.index(f) for f, _ in IDEAL]]).astype(int)
        lang = np.concatenate([measures.lang, ideal.lang])
        views = {}
        for v in VIEWS:
            (r, c, k), (r2, c2, k2) = measures.view(v), ideal.view(v)
            dense = np.zeros((len(form), VIEWS[v]))
            dense[np.concatenate([r, r2 + n]), np.concatenate([c, c2])] = np.concatenate([k, k2])
            views[v] = dense / np.maximum(dense.sum(1, keepdims=True), 1e-9)
        shape = np.sqrt(np.concatenate([views[v] for v in ("pairs", "words", "lines")], 1))
        groups = [np.flatnonzero((form == 0) & (lang == k)) for k in range(len(LANGUAGES))]
        for f in range(1, len(FORMS)):
            mine = np.flatnonzero(form == f)
            near = _clusters(shape[mine], max(1, min(KINDS, len(mine) // KIND_DOCS)))
            groups += [mine[near == j] for j in range(near.max() + 1)]
        groups = [g for g in groups if len(g)]
        self.by_view = {v: np.array([views[v][g].mean(0) for g in groups]) for v in ("pairs", "words", "lines")}
        # function words: each language has its own prose
        self.by_view["function"] = np.array([views["function"][(form == 0) & (lang == k)].mean(0) for k in range(len(LANGUAGES))])
        x = np.concatenate([self.vectors(measures), self.vectors(ideal)])
        self.fit(x, form)

    def fit(self, x: np.ndarray, form: np.ndarray) -> None:
        self.place = np.array([x[form == f].mean(0) for f in range(len(FORMS))])
        off = x - self.place[form]
        spread = off.T @ off / len(x)
        mean = np.trace(spread) / len(spread)
        few = 20.0 / (20.0 + len(x))
        spread = (1 - few) * spread + (few + 1e-3) * mean * np.eye(len(spread))
        self.metric = np.linalg.inv(spread)

    def vectors(self, m: Measures) -> np.ndarray:
        """Divergences of each text from the profiles: all for characters, words and lines; its own language's for function words."""
        cols = [divergences(*m.view(v), m.n, self.by_view[v]) for v in ("pairs", "words", "lines")]
        words_of = divergences(*m.view("function"), m.n, self.by_view["function"])
        cols.append(np.where(m.lang >= 0, words_of[np.arange(m.n), m.lang], 1.0)[:, None])
        return np.concatenate(cols, 1)

    def forms(self, m: Measures) -> list[str]:
        x, p = self.vectors(m), self.place
        return [FORMS[i] for i in (np.einsum("ij,jk,ik->i", p, self.metric, p) - 2 * x @ self.metric @ p.T).argmin(1)]


def _joined(found: list[tuple[np.ndarray, np.ndarray, Measures]]) -> tuple[Measures, np.ndarray]:
    """Measures of several batches (keys, forms, measures) in order of the keys, and the forms."""
    keys, forms = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    out = Measures(len(keys))
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    start = 0
    for _, _, m in found:
        mine = place[start : start + m.n]
        out.lang[mine] = m.lang
        for v in VIEWS:
            r, c, k = m.view(v)
            out.found[v].append((mine[r], c, k))
        start += m.n
    return out, forms[order]


def fit_profiles(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_LABELS) -> Profiles:
    """Fitted on at most ``most`` labelled documents, those of the least hash, in one task that gets their counts, not their texts; only the profiles come to the driver.

    Labels are trimmed and lower-cased; unknown and null ones and documents with several forms are left
    out. Of several texts of one document the least counts. Without labels the ideal texts stand alone.
    """
    form = F.lower(F.trim("form"))
    lab = labels.select("doc_id", form.alias("form")).where(form.isin(*FORMS) & F.col("doc_id").isNotNull())
    lab = lab.groupBy("doc_id").agg(F.min("form").alias("form"), F.max("form").alias("f2")).where("form = f2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    lab = materialize(lab.select("doc_id", "form"), "labels")
    rows = documents.select("doc_id", "text").where("text is not null").join(fixed_broadcast(lab, most), "doc_id").groupBy("doc_id", "form").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, FORMS.index(f), t) for h, f, t in zip(b["h"].to_pylist(), b["form"].to_pylist(), b["text"].to_pylist()) if t.strip()]
            if rows:
                h, f, t = zip(*rows)
                blob = pickle.dumps((np.array(h, np.int64), np.array(f), measure(list(t))))
                yield pa.RecordBatch.from_pydict({"one": pa.array([1], pa.int32()), "blob": pa.array([blob], pa.binary())})

    def fit(group: pa.Table) -> pa.Table:
        found = [pickle.loads(x) for x in group["blob"].to_pylist()]
        return pa.table({"blob": pa.array([pickle.dumps(Profiles(*_joined(found)))], pa.binary())})

    sent = rows.select(F.xxhash64("doc_id").alias("h"), "form", "text").mapInArrow(count, "one int, blob binary")
    got = sent.groupBy("one").applyInArrow(fit, "blob binary").collect()
    return pickle.loads(got[0]["blob"]) if got else Profiles(Measures(0), np.empty(0, int))


def text_statistics(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words, form) of each document.

    symbol_ratio is the share of characters that are no letters, digits or blanks in all that are no
    blanks; punctuated_lines the share of lines that are not blank and end in punctuation; common_words
    the share of words that are function words of the language with most of them. A null or blank text
    has no words, and nulls for the rest. Whole texts are read.
    """
    kind = dict(documents.dtypes)[key]
    profiles = documents.sparkSession.sparkContext.broadcast(fit_profiles(documents.withColumnRenamed(key, "doc_id"), labels))
    names = ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = profiles.value
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            blank = np.array([not t.strip() for t in texts], bool)
            m = measure(texts)
            share = lambda a, b: pa.array(a / np.maximum(b, 1), pa.float64(), mask=blank)
            cols = (share(m.word_chars, m.words), share(m.symbols, m.visible), share(m.closed, m.lines), share(m.common, m.words))
            yield pa.RecordBatch.from_pydict({key: b[key], "n_words": pa.array(np.where(blank, 0, m.words), pa.int64())} | dict(zip(names, cols)) | {"form": pa.array(np.array(fitted.forms(m), object), pa.string(), mask=blank)})

    return documents.select(key, "text").mapInArrow(count, f"{key} {kind}, n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, form string")
