"""Language of each document and of each stretch of lines, with a confidence.

Method: averaged hashed subword embeddings with a linear softmax, trained by stochastic
gradient descent in numpy, with calibrated rejection. A line is the mean of the embeddings
of its character n-grams (hashed, within words, with word bounds); a linear layer and a
softmax give the probabilities. A temperature is fitted on held-out lines, and lines whose
calibrated probability stays below the rejection threshold leave the decision to the lines
around them. Runs of lines follow from a Viterbi pass with a price for each change.

The classifier is fitted on a bounded sample of labelled lines (``TRAIN_LINES``, chosen by
hash) and applied to every line of every text; both embeddings and weights fold into one
table of bucket scores, so applying it is a gather and a segmented sum.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.sampling import hash_sample

LANGS = ["en", "de", "fr", "es", "pt", "it", "nl", "ru", "ko", "ja"]

#: Codes, English names and native names of the languages.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish castilian español espanol castellano",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch flemish nederlands vlaams",
    "ru": "ru rus russian русский",
    "ko": "ko kor korean 한국어 조선말",
    "ja": "ja jpn japanese 日本語 にほんご",
}

#: A few plain words of each language, so that a fit needs no minimum of labels.
SEED = {
    "en": "the and of to in is was for that with this not are be by from have it as on which you will can please has been before after",
    "de": "der die das und ist nicht mit von für auf ein eine dem den wurde werden bitte noch nach vor auch zu im wir sie sind wird über",
    "fr": "le la les des et est pas avec pour dans une un que qui sur nous vous ce cette merci par plus avant après été encore au du",
    "es": "el la los las y es no con para por una un que del se en al está están fue ha antes después también ya su lo como más",
    "pt": "o a os as e é não com para por uma um que do da se em ao está foi ainda antes depois também já seu como mais pelo pela",
    "it": "il lo la gli le e è non con per una un che del della si in al sono stato ancora prima dopo anche già più come nel nella",
    "nl": "de het een en is niet met van voor op dat zijn wordt werd nog na ook te we u wij maar om bij uit naar heeft aan dit",
    "ru": "и в не на с что это как по для из был была было уже ещё после перед также мы вы его она они если или до от так нет",
    "ko": "이 그 은 는 을 를 에서 으로 하고 있습니다 합니다 했습니다 없습니다 그리고 지난 때문입니다 주세요 아직 자료 내용",
    "ja": "これ それ です ます ました の は を に が で と も から まで ください ありません この その まだ について 件 先 後",
}

BUCKETS = 1 << 16
DIM = 16
ORDERS = (1, 2, 3, 4)
#: Labelled lines the classifier is fitted on, at most.
TRAIN_LINES = 16_000
EPOCHS = 3
#: Line updates a fit makes at least, so that a few lines are fitted as well.
LEAST_UPDATES = 6000
RATE = 0.05
#: Share of held-out lines that must be right among those not rejected.
ACCEPT = 0.995
#: Price of a change of language between lines, in units of log probability.
SWITCH = 5.0
#: Letters from which a line counts in full; an East Asian letter stands for three.
FULL_LETTERS = 40


def label_language(label: Column) -> Column:
    """The language a label names, or null: a code, locale, English or native name in any letter case."""
    word = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_][\p{L}\p{N}_-]*)?$", 1)
    pairs = [F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)]
    return F.try_element_at(F.create_map(*pairs), word)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the letter it counts as (space for none), and its letter weight."""
    codes = np.full(0x110000, 32, np.uint32)
    weight = np.zeros(0x110000, np.float32)
    for o in [*range(0x20, 0x2FA20)]:
        ch = chr(o)
        if ch.isalpha():
            codes[o] = ord(ch.lower()[0])
            weight[o] = 3 if o >= 0x1100 and not 0x1E00 <= o < 0x2000 else 1
        elif unicodedata.category(ch) in ("Cf", "Mn"):
            codes[o] = 0
    codes[10] = 10
    codes[0x2019] = codes[0x27] = 0x27
    return codes, weight


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, line) of every n-gram of the lines of ``text``, and the letters of each line."""
    codes, weight = _classes()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    raw = np.frombuffer(("\n" + text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.minimum(raw, 0x10FFFF)
    own = codes[raw]
    keep = own != 0
    own, letters = own[keep], weight[raw[keep]]
    line_of = np.cumsum(own == 10) - 1
    lines = int(line_of[-1])
    per_line = np.bincount(line_of, letters, lines + 1)[:lines]
    edge = (own == 32) | (own == 10)
    sym = np.where(own == 10, 32, own).astype(np.uint32)
    buckets, places = [], []
    n_all = len(own)
    for n in ORDERS:
        m = n_all - n + 1
        if m <= 0:
            continue
        h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        ok = np.ones(m, bool)
        for k in range(n):
            part = slice(k, k + m)
            h = (h ^ sym[part]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
            if 0 < k < n - 1 or n == 1:
                ok &= ~edge[part]
        if n == 2:
            ok &= ~(edge[:m] & edge[1 : 1 + m])
        elif n > 2:
            # Bounds on both sides of a single gap hold no letter of their own.
            ok &= ~(edge[:m] & edge[1 : 1 + m])
        # An n-gram belongs to the line of its second symbol, which is never its closing bound.
        at = np.nonzero(ok)[0]
        buckets.append(((h[at] ^ (h[at] >> np.uint32(16))) & np.uint32(BUCKETS - 1)).astype(np.int32))
        places.append(line_of[at + (1 if n > 1 else 0)] if n != 2 else line_of[np.where(edge[at], at + 1, at)])
    bucket, place = np.concatenate(buckets), np.concatenate(places)
    inside = (place >= 0) & (place < lines)
    return bucket[inside], place[inside], per_line


#: Code point ranges of letters by script.
SCRIPTS = {
    "latin": [(0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0xFF21, 0xFF5B)],
    "cyrillic": [(0x400, 0x500)],
    "hangul": [(0x1100, 0x1200), (0x3130, 0x3190), (0xAC00, 0xD7A4)],
    "kana": [(0x3041, 0x3100), (0xFF66, 0xFFA0)],
    "han": [(0x3400, 0xA000)],
}


def scripts(text: str, n: int) -> np.ndarray:
    """Per line and language: whether the line's letters let it be in the language.

    Korean needs Hangul, Japanese kana or Han, Russian Cyrillic; the others need at least as
    many Latin as Cyrillic letters, and three for each East Asian one.
    """
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.cumsum(raw == 10)
    count = {}
    for name, ranges in SCRIPTS.items():
        hit = np.zeros(len(raw), bool)
        for a, b in ranges:
            hit |= (raw >= a) & (raw < b)
        count[name] = np.bincount(line[hit], minlength=n)[:n]
    east = count["hangul"] + count["kana"] + count["han"]
    ok = np.repeat(((count["latin"] >= count["cyrillic"]) & (count["latin"] >= 3 * east))[:, None], len(LANGS), 1)
    ok[:, LANGS.index("ko")] = count["hangul"] > 0
    ok[:, LANGS.index("ja")] = count["kana"] + count["han"] > 0
    ok[:, LANGS.index("ru")] = count["cyrillic"] > 0
    ok[~ok.any(1)] = True
    return ok


class Classifier:
    """Bucket scores, bias, temperature and rejection threshold of a fitted classifier."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, heat: float = 1.0, floor: float = 0.5):
        self.table, self.bias, self.heat, self.floor = table, bias, heat, floor

    def lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log probabilities and letters of each line of ``text``."""
        bucket, place, letters = ngrams(text)
        n = len(letters)
        count = np.bincount(place, minlength=n)
        sums = np.empty((n, len(LANGS)), np.float32)
        for k in range(len(LANGS)):
            sums[:, k] = np.bincount(place, self.table[k][bucket], n)
        z = (sums / np.maximum(count, 1)[:, None] + self.bias) / self.heat
        z[~scripts(text, n)] = -40.0
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True)), letters


def _scatter(target: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """target[ids] += rows, for repeated ids."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    first = np.nonzero(np.r_[True, ids[1:] != ids[:-1]])[0]
    target[ids[first]] += np.add.reduceat(rows, first, axis=0)


def _sgd(buckets: list[np.ndarray], labels: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output layer and bias; rarer languages weigh more, the rate falls to zero."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (DIM, len(LANGS))).astype(np.float32)
    bias = np.zeros(len(LANGS), np.float32)
    share = np.bincount(labels, minlength=len(LANGS))
    weight = np.minimum(4.0, np.sqrt(share.max() / np.maximum(share, 1))).astype(np.float32)
    n, size = len(labels), 32
    epochs = max(EPOCHS, -(-LEAST_UPDATES // n))
    steps, step = epochs * -(-n // size), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, size):
            rows = order[a : a + size]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            ids = np.concatenate([buckets[i] for i in rows])
            lens = np.array([len(buckets[i]) for i in rows], np.float32)
            starts = np.r_[0, np.cumsum(lens)[:-1]].astype(np.int64)
            mean = np.add.reduceat(emb[ids], starts, axis=0) / lens[:, None]
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weight[labels[rows]][:, None]
            back = p @ out.T
            out -= rate * 0.2 * (mean.T @ p)
            bias -= rate * 0.02 * p.sum(0)
            # As usual for averaged bags, each n-gram takes the whole error of its line, not its share.
            _scatter(emb, ids, (-rate * back)[np.repeat(np.arange(len(rows)), lens.astype(np.int64))])
    return emb, out, bias


def fit(lines: list[str], labels: list[str], seed: int = 7) -> Classifier:
    """Fit on labelled lines, some of them wrongly labelled.

    A first fit finds the lines it is sure are labelled wrongly; the second fit leaves them
    out. One line in seven is held out of both to fit the temperature and the threshold.
    """
    lines = [*lines, *(s for s in SEED.values() for _ in range(3))]
    code = {c: k for k, c in enumerate(LANGS)}
    y = np.array([*(code[v] for v in labels), *(code[c] for c in SEED for _ in range(3))])
    bucket, place, _ = ngrams("\n".join(v.replace("\n", " ") for v in lines))
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(len(lines) + 1))
    ids = [bucket[order[a:b]] for a, b in zip(cuts, cuts[1:])]
    use = np.array([k for k in range(len(lines)) if len(ids[k]) > 8 or k >= len(labels)])
    held = (use % 7 == 3) & (use < len(labels))

    def logits(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.array([emb[ids[k]].mean(0) @ out + bias for k in rows])

    train = use[~held]
    model = _sgd([ids[k] for k in train], y[train], seed)
    z = logits(*model, train)
    top = z.max(1)
    doubt = (z.argmax(1) != y[train]) & (top - z[np.arange(len(train)), y[train]] > 1.5) & (train < len(labels))
    train = train[~doubt]
    emb, out, bias = _sgd([ids[k] for k in train], y[train], seed + 1)
    heat, floor = 1.0, 0.5
    test = use[held]
    if len(test) >= 50:
        z = logits(emb, out, bias, test)
        right = z.argmax(1) == y[test]
        sure = np.sort(z, 1)
        clean = right | (sure[:, -1] - z[np.arange(len(test)), y[test]] < 2.0)
        z, t = z[clean], y[test][clean]

        def loss(h: float) -> float:
            v = z / h
            v = v - v.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(v).sum(1)) - v[np.arange(len(t)), t]))

        heat = min((0.25 * 1.15**k for k in range(24)), key=loss)
        v = z / heat
        p = np.exp(v - v.max(1, keepdims=True))
        conf = p.max(1) / p.sum(1)
        ok = z.argmax(1) == t
        by = np.argsort(-conf)
        rate = np.cumsum(ok[by]) / np.arange(1, len(by) + 1)
        good = np.nonzero(rate >= ACCEPT)[0]
        floor = float(np.clip(conf[by][good[-1]] if len(good) else 0.9, 0.3, 0.9))
    return Classifier(np.ascontiguousarray((emb @ out).T.astype(np.float32)), bias, heat, floor)


def segments(model: Classifier, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """(first line, last line, language, confidence) of the runs of each text.

    Lines without letters extend the run before; a text without letters has no run.
    """
    texts = [(t or "").replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    counts = [t.count("\n") + 1 for t in texts]
    logp, letters = model.lines("\n".join(texts))
    out, base = [], 0
    for n in counts:
        lp, le = logp[base : base + n], letters[base : base + n]
        base += n
        rows = np.nonzero(le > 0)[0]
        if not len(rows):
            out.append([])
            continue
        lp, le = lp[rows], le[rows]
        sure = lp.max(1) >= np.log(model.floor)
        w = np.minimum(1.0, le / FULL_LETTERS) ** 2
        ev = np.maximum(lp, -14.0) * (w * np.where(sure, 1.0, 0.25))[:, None]
        total = ev.sum(0)
        best = int(total.argmax())
        if (ev[:, best] >= ev.max(1) - 1e-6).all():
            path = np.full(len(rows), best)
        else:
            path = _viterbi(ev)
        runs, a = [], 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or path[k] != path[a]:
                c = path[a]
                weight = w[a:k] + 1e-3
                conf = float((np.exp(lp[a:k, c]) * weight).sum() / weight.sum())
                runs.append((int(rows[a]), int(rows[k - 1]), LANGS[c], conf))
                a = k
        out.append(runs)
    return out


def _viterbi(ev: np.ndarray) -> np.ndarray:
    score, back = ev[0].copy(), np.zeros(ev.shape, np.int8)
    for k in range(1, len(ev)):
        best = int(score.argmax())
        move = score[best] - SWITCH
        back[k] = np.where(score >= move, np.arange(ev.shape[1]), best)
        score = np.maximum(score, move) + ev[k]
    path = np.empty(len(ev), np.int64)
    path[-1] = score.argmax()
    for k in range(len(ev) - 1, 0, -1):
        path[k - 1] = back[k][path[k]]
    return path


def labelled_lines(docs: DataFrame, text: str, lang: str, limit: int = TRAIN_LINES) -> tuple[list[str], list[str]]:
    """At most ``limit`` labelled lines, chosen by hash of the line; a repeated line counts once."""
    lines = (
        docs.where(F.col(text).isNotNull())
        .select(label_language(F.col(lang)).alias("label"), F.explode(F.split(F.col(text), "\n")).alias("line"))
        .where("label IS NOT NULL AND length(line) BETWEEN 12 AND 2000")
    )
    rows = hash_sample(lines, ["line", "label"], limit).collect()
    return [r.line for r in rows], [r.label for r in rows]


def label_segments(docs: DataFrame, model: Classifier, key: str, text: str, keep: list[str]) -> DataFrame:
    """One row per run of lines: key, kept columns, seg_no, seg_lang, confidence, line and character bounds, runs.

    Null and empty texts, and texts without a letter, give no row. Bounds are half-open in
    code points of the stored text; a text of one language is one row.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.heat, model.floor))
    types = {c: docs.schema[c].dataType.simpleString() for c in [key, *keep]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Classifier(*held.value)
        for batch in batches:
            rows = []
            texts = batch[text].tolist()
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                for k, runs in enumerate(segments(own, part)):
                    if not runs:
                        continue
                    head = [batch[c].iloc[at + k] for c in [key, *keep]]
                    cuts = _line_starts(part[k])
                    for no, (a, b, lang, conf) in enumerate(runs, 1):
                        rows.append((*head, no, lang, round(conf, 6), cuts[a][0], cuts[b][1], len(runs)))
            yield pd.DataFrame(rows, columns=[*types, "seg_no", "seg_lang", "confidence", "seg_start", "seg_end", "runs"])

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    return (
        docs.select(key, text, *keep)
        .where(F.col(text).rlike(r"\p{L}"))
        .mapInPandas(run, f"{schema}, seg_no int, seg_lang string, confidence double, seg_start int, seg_end int, runs int")
    )


def _line_starts(text: str) -> list[tuple[int, int]]:
    """Start and end of each line in code points; CR LF and CR end a line as LF does."""
    out, at = [], 0
    for line in text.replace("\r\n", "\n\x00").replace("\r", "\n").split("\n"):
        skip = line.startswith("\x00")
        a = at + skip
        out.append((a, a + len(line) - skip))
        at = a + len(line) - skip + 1
    return out
