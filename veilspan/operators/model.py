"""Decoding of token classifiers: constrained Viterbi, token labels to spans, label names.

Logits come from an injected ``LogitsRunner``; no model is shipped. Decoding runs in Arrow
batches: one document's tokens are one row, so nothing shuffles.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veilspan.catalog import BIOES_LABELS, KIND_ALIASES

Span = tuple[str, int, int]
_ALIAS = {n: kind for kind, names in KIND_ALIASES.items() for n in names}
#: Punctuation that joins two parts of one entity.
_CONNECTORS = frozenset("!\"#$%&'()*+-./:<=>?@[\\]^_`{|}~")


class LogitsRunner(Protocol):
    """Text to token offsets (code points) and logits."""

    def __call__(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]: ...


def split_label(label: str) -> tuple[str, str]:
    """('B', kind) of 'B-kind'; ('', '') for a label without a hyphen."""
    head, mark, kind = label.partition("-")
    return (head, kind) if mark else ("", "")


def bioes_rules(labels: list[str] = BIOES_LABELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(may start, may end, may follow) for begin-inside-end-single labels."""
    parts = [split_label(x) for x in labels]
    open_after = np.array([p in "BI" and p != "" for p, _ in parts])
    continues = np.array([p in "IE" and p != "" for p, _ in parts])
    kinds = np.array([k for _, k in parts])
    same = kinds[:, None] == kinds[None, :]
    follow = np.where(open_after[:, None], continues[None, :] & same, ~continues[None, :])
    return ~continues, ~open_after, follow


def bio_rules(labels: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for begin-inside labels: inside only continues its own kind."""
    parts = [split_label(x) for x in labels]
    inside = np.array([p == "I" for p, _ in parts])
    entity = np.array([p in ("B", "I") for p, _ in parts])
    kinds = np.array([k for _, k in parts])
    same = (kinds[:, None] == kinds[None, :]) & entity[:, None]
    return ~inside, np.ones(len(labels), bool), np.where(inside[None, :], same, True)


def viterbi(logits: np.ndarray, start: np.ndarray, end: np.ndarray, follow: np.ndarray) -> list[int]:
    """The best allowed label sequence.

    Equal predecessors: the lowest; equal last labels: the highest. A logit that is not finite
    closes its label at that token. Without any allowed sequence every token takes its largest
    logit, the last of equal ones. Rows shorter than the label set lack the missing labels.
    """
    x = np.full((len(logits), len(start)), -np.inf, np.float32)
    for t, row in enumerate(logits):
        x[t, : min(len(row), len(start))] = np.asarray(row, np.float32)[: len(start)]
    if not len(x):
        return []
    score = np.where(start, x[0], -np.inf).astype(np.float32)
    back = np.zeros(x.shape, np.int64)
    block = np.where(follow, 0, -np.inf).astype(np.float32)
    for t in range(1, len(x)):
        ways = score[:, None] + block
        ways = np.where(np.isnan(ways), -np.inf, ways)
        back[t] = ways.argmax(0)
        best = ways[back[t], np.arange(x.shape[1])] + x[t]
        score = np.where(np.isfinite(x[t]) & (best > -np.inf), best, -np.inf).astype(np.float32)
        back[t][score == -np.inf] = 0
    last = np.where(end, score, -np.inf)
    state = len(last) - 1 - int(last[::-1].argmax())
    if not np.isfinite(last[state]):
        return [len(r) - 1 - int(np.asarray(r)[::-1].argmax()) for r in logits]
    path = [state]
    for t in range(len(x) - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return path[::-1]


def normal_kind(kind: str) -> str:
    k = kind.lower().replace(" ", "_").replace("-", "_")
    return _ALIAS.get(k, k)


def _usable(text: str, offsets: list[tuple[int, int]], labels: list[int]) -> Iterator[tuple[int, int, int]]:
    """Tokens with a place in the text; others neither extend nor end a span."""
    for (a, b), label in zip(offsets, labels):
        if 0 <= a < b <= len(text):
            yield a, b, label


def bioes_spans(text: str, offsets: list[tuple[int, int]], labels: list[int], names: list[str] = BIOES_LABELS) -> list[Span]:
    """Spans of begin-inside-end-single labels; broken sequences still give their parts."""
    out: list[Span] = []
    now: list | None = None

    def close() -> None:
        nonlocal now
        if now:
            out.append(tuple(now))
        now = None

    for a, b, label in _usable(text, offsets, labels):
        part, kind = split_label(names[label]) if 0 <= label < len(names) else ("", "")
        same = now is not None and now[0] == kind
        if part in ("I", "E") and same:
            now[2] = b
        else:
            close()
            if part:
                now = [kind, a, b]
        if part in ("E", "S"):
            close()
    close()
    return out


def bio_spans(text: str, offsets: list[tuple[int, int]], labels: list[int], names: list[str]) -> list[Span]:
    """Neighbouring tokens of one kind merged, whatever their prefix; then short connectors bridged."""
    out: list[Span] = []
    now: list | None = None
    for a, b, label in _usable(text, offsets, labels):
        if not 0 <= label < len(names):
            continue
        _, mark, raw = names[label].partition("-")
        kind = normal_kind(raw) if mark else None
        if now and now[0] == kind:
            now[2] = b
            continue
        if now:
            out.append(tuple(now))
        now = [kind, a, b] if kind is not None else None
    if now:
        out.append(tuple(now))
    return bridged(text, out)


def bridged(text: str, spans: list[Span]) -> list[Span]:
    """Spans of one kind joined over at most three bytes of connecting punctuation."""
    out: list[list] = []
    for kind, a, b in spans:
        if out and out[-1][0] == kind:
            gap = text[out[-1][2] : max(a, out[-1][2])]
            if len(gap.encode()) <= 3 and all(c in _CONNECTORS for c in gap):
                out[-1][2] = max(b, out[-1][2])
                continue
        out.append([kind, a, b])
    return [tuple(s) for s in out]


def finished(text: str, spans: list[Span]) -> list[tuple[str, str, str, int, int]]:
    """(match_id, kind, value, start, end): blanks off both ends, empty spans dropped, ordered by start."""
    out = []
    for kind, a, b in spans:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((f"onnx-{kind}-{a}-{len(out)}", kind, text[a:b], a, b))
    return sorted(out, key=lambda s: s[3])


def label_names(config: str) -> list[str]:
    """Labels of a model config in the order of their numeric ids; ids that are no numbers are dropped."""
    pairs = json.loads(config).get("id2label", {}).items()
    return [name for _, name in sorted((int(i), n) for i, n in pairs if str(i).strip().isdigit())]


def decoder(scheme: str, names: list[str] | None = None) -> Callable[[str, list, np.ndarray], list]:
    """(text, offsets, logits) -> finished spans, for 'bioes' over the taxonomy or 'bio' over ``names``."""
    labels = names or BIOES_LABELS
    rules = bioes_rules(labels) if scheme == "bioes" else bio_rules(labels)
    to_spans = bioes_spans if scheme == "bioes" else bio_spans
    return lambda text, offsets, logits: finished(text, to_spans(text, offsets, viterbi(logits, *rules), labels))


def detect_model(docs: DataFrame, runner: Callable[[], LogitsRunner], key: str, text: str = "text", scheme: str = "bioes", names: list[str] | None = None) -> DataFrame:
    """(key, match_id, kind, value, start, end) from a runner built once per Python worker.

    ``runner`` is a picklable factory. Null and blank texts are not run.
    """
    kind_of_key = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, decode = runner(), decoder(scheme, names)
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                if t and t.strip():
                    offsets, logits = model(t)
                    rows += [(k, *s) for s in decode(t, offsets, logits)]
            yield pd.DataFrame(rows, columns=[key, "match_id", "kind", "value", "start", "end"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind_of_key}, match_id string, kind string, value string, start int, end int")


def decode_rows(rows: DataFrame, key: str, scheme: str = "bioes", names: list[str] | None = None) -> DataFrame:
    """Spans of stored logits: rows (key, text, token_offsets array<struct<start,end>>, logits array<array<float>>)."""
    kind_of_key = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = decoder(scheme, names)
        for batch in batches:
            out = []
            for k, t, o, z in zip(batch[key], batch["text"], batch["token_offsets"], batch["logits"]):
                offsets = [(int(x["start"]), int(x["end"])) for x in o]
                out += [(k, *s) for s in decode(t, offsets, [np.asarray(r, np.float32) for r in z])]
            yield pd.DataFrame(out, columns=[key, "match_id", "kind", "value", "start", "end"])

    return rows.select(key, "text", "token_offsets", "logits").mapInPandas(run, f"`{key}` {kind_of_key}, match_id string, kind string, value string, start int, end int")


def onnx_runner(model_path: str, tokenizer_path: str) -> LogitsRunner:
    """A runner over an ONNX token classifier; one thread, since Spark runs one per core."""
    import onnxruntime
    from tokenizers import Tokenizer

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_BASIC
    session = onnxruntime.InferenceSession(model_path, options, providers=["CPUExecutionProvider"])
    tokenizer = Tokenizer.from_file(tokenizer_path)

    def run(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        e = tokenizer.encode(text)
        ids = np.array([e.ids], np.int64)
        if not ids.size:
            return [], np.zeros((0, 0), np.float32)
        return list(e.offsets), session.run(None, {"input_ids": ids, "attention_mask": np.array([e.attention_mask], np.int64)})[0][0]

    return run
