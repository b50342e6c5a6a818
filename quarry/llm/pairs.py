"""Problem 4: broken prompt and response pairs.

Noisy labelling functions vote for or against each defect of a pair; most abstain on most pairs.
For each defect an expectation-maximization label model learns from the counts of vote patterns
over all pairs how far each function can be trusted and how common the defect is, and turns a
pattern into a posterior. The cutoff of a defect is validated on all pairs once more, with
defects seeded, so that it is known which pairs have it: it is the one with the best F1 there,
at the share of the defect that the model finds. A pair may keep several, `defect` is the first by rank.
"""

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.conversations import ordered_turns

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")
#: Different replies whose features a worker remembers, and their characters at most; those that are seeded are fewer and shorter.
REMEMBERED, REMEMBERED_CHARS = 2048, 300

# Common short words by language.
_COMMON = {
    "en": "the a an of to in is are and or that this with for what how does do which where why when it be can has have not you i it's was were by on as from who needs every each one show please explain list write about",
    "de": "der die das den dem des ein eine einen einem und oder ist sind nicht mit auf für von zu im in wird werden was wie wo warum kann kannst du ich sie wir man nach dem jede jeder wenn ohne bitte zusammen ihrer dafür leider dabei wurde bleibt muss zuerst",
    "fr": "le la les un une des du de et ou est sont ne pas avec pour dans que qui ce cette comment où pourquoi peux tu je nous vous il elle quand sans chaque après avant d'abord puis à au aux en sa son réponds reste faut",
    "es": "el la los las un una de del y o es está son no con para en que qué cómo dónde por puedes yo tú nosotros se hay cada cuando sin antes después primero su junto lo al como puedo eso queda trata hace",
}
_COMMON = {k: frozenset(v.split()) for k, v in _COMMON.items()}
_SPOKEN = {w: [k for k, common in _COMMON.items() if w in common] for w in frozenset().union(*_COMMON.values())}
# The names under which a prompt may ask for a language.
_ASKED = {
    "en": r"\b(?:in english|auf englisch|en anglais|en inglés)\b",
    "de": r"\b(?:in german|auf deutsch|en allemand|en alemán)\b",
    "fr": r"\b(?:in french|auf französisch|en français|en francés)\b",
    "es": r"\b(?:in spanish|auf spanisch|en espagnol|en español)\b",
}
_ASKED = {k: re.compile(v) for k, v in _ASKED.items()}

_WORD = re.compile(r"\w+(?:['’]\w+)?")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|\b\w+_\w+\b|\b\w+\.\w{1,4}\b")
_SPEAKER = re.compile(
    r"\b(?:can(?:no|['’])?t|can not|unable to|able to|allowed to|permitted to|decline to|refuse to|rather not|comfortable|appropriate (?:for me )?to|leave your|forbid me to|keep me from|may(?: not)?|no)\b[^.!?\n]{0,30}?\b(?:help|assist|answer(?:ing)?|discuss(?:ing)?|explain(?:ing)?|explanation|share|describe|comment|respond|provid(?:e|ing)|go into|question)\b"
    r"|\bnot (?:something|anything) (?:i|we) can do\b|\b(?:beyond|outside) what (?:i|we)\b|\bexplaining [^.\n]{0,50} is against\b|\bstay away from\b|\btalk about something else\b|\bno puedo (?:ayudar|responder|contestar|hablar)|\bno me es posible\b|\bje (?:ne peux|refuse|préfère ne)\b|\b(?:kann|darf|möchte) (?:ich )?(?:dabei|das|dazu|ihnen|dir|diese \w+)?\s*(?:leider )?nicht\b[^.]{0,30}\b(?:helfen|beantworten|sagen|antworten|äußern)"
)
_POLICY = re.compile(
    r"\b(?:guidelines?|polic(?:y|ies)|instructions|not allowed|not permitted|permitted to|restricted|appropriate for me|comfortable (?:providing|answering|discussing)|told to stay|beyond what|outside what|must decline|decline to|rather not|no comment|something else instead|forbid|unable to (?:answer|help|assist|discuss)|able to assist|help with that|keep me from|ayudarte|désolé|cette demande|dabei nicht helfen)\b"
)
_REDIRECT = re.compile(r"\b(?:another question|anything else|someone else|something else|ask (?:a|the|your) \w+|consult|maintainer|handbook yourself|elsewhere|leave your question)\b")
_FRAME = re.compile(r"\b(?:question|answer|you asked|your question(?: was)?|you said|prompt|frage|antwort|pregunta|respuesta|réponse)\b\s*[:\-–]|^\s*>+", re.M)
_ENDS = re.compile(r"[.!?…。][\"'”’)\]*_`]*$")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+(.*)$")
_MASK = re.compile(r"\w+")
_ALNUM = re.compile(r"[^\W_]")


def _prose(text: str) -> str:
    return _INLINE.sub(" ", _FENCE.sub(" ", text))


def language(text: str) -> tuple[str | None, int, int]:
    """The language whose common words a text has most of, how many, and the lead over the next; None when it cannot be told."""
    found = dict.fromkeys(_COMMON, 0)
    for w in _WORD.findall(_prose(text).lower()):
        for k in _SPOKEN.get(w, ()):
            found[k] += 1
    hits = sorted(((n, k) for k, n in found.items()), reverse=True)
    (best, k), (second, _) = hits[0], hits[1]
    return (k if best >= 2 and best > second else None), best, best - second


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _shape(item: str) -> str:
    return _MASK.sub("w", item.strip())


def _cut_list(lines: list[str]) -> bool:
    """Whether the last item of a list is shorter in kind than the others: cut off."""
    items = [m[1] for m in map(_ITEM.match, lines) if m]
    if len(items) < 2:
        return False
    shapes = Counter(_shape(i) for i in items[:-1])
    last = _shape(items[-1])
    return last not in shapes and any(s.startswith(last) and s != last for s in shapes)


@lru_cache(maxsize=8)
def _of_prompt(prompt: str) -> tuple:
    """A prompt's words, their set and triples, its language, whether it asks for some language, and the languages a reply may have."""
    asked = _words(prompt)
    named = {k for k, rx in _ASKED.items() if rx.search(prompt.lower())}
    told = language(prompt)
    return asked, set(asked), {tuple(asked[i : i + 3]) for i in range(max(1, len(asked) - 2))}, told, bool(named), named | {told[0]}


@lru_cache(maxsize=REMEMBERED)
def _of_reply(reply: str) -> tuple:
    """What a reply alone decides: letters and digits (2 at most), words, language and the votes on `empty`, `refusal` and `truncated`."""
    stripped = reply.strip()
    first = _ALNUM.search(reply)
    alnum = 0 if first is None else 2 if _ALNUM.search(reply, first.end()) else 1
    empty = (1 if alnum == 0 else -1, 1 if len(stripped) <= 3 and not alnum else -1 if len(stripped) > 12 else 0, -1 if alnum >= 2 else 0)
    sentences = [s for s in re.split(r"(?<=[.!?;])\s+", stripped) if s]
    head = " ".join(sentences[:1])
    low = stripped.lower()
    speaker, policy, redirect = bool(_SPEAKER.search(low)), bool(_POLICY.search(low)), bool(_REDIRECT.search(low))
    brief = len(sentences) <= 3 and "```" not in stripped
    refusal = (
        1 if speaker else -1,
        1 if policy and brief else -1 if not policy else 0,
        1 if redirect and brief else 0,
        0 if brief else -1,
        1 if (speaker or policy) and len(head) >= 0.4 * len(stripped) else -1 if not (speaker or policy) else 0,
    )
    lines = [x for x in stripped.split("\n") if x.strip()]
    fenced = reply.count("```") % 2 == 1
    ended = bool(_ENDS.search(stripped)) or stripped.endswith("```")
    last = lines[-1] if lines else ""
    listed = bool(_ITEM.match(last)) and not _cut_list(lines)
    terse = len(stripped.split()) <= 3 and not re.search(r"[,;:(\[-]$", stripped)
    opened = last.count("(") > last.count(")") or last.count("`") % 2 == 1
    complete = (ended or listed or terse) and not fenced and not _cut_list(lines)
    truncated = (
        1 if fenced else 0,
        -1 if complete or not alnum else 1,
        1 if re.search(r"[,;(\[{=+\-]$", stripped) and alnum else -1 if ended else 0,
        1 if not ended and not listed and not terse and alnum and (opened or re.search(r"\w$", stripped)) else -1 if ended and not fenced else 0,
    )
    return alnum, _WORD.findall(_FRAME.sub(" ", reply.lower())), language(reply), empty, refusal, truncated


def votes(prompt: str, reply: str) -> dict[str, tuple[int, ...]]:
    """Per defect the votes of its labelling functions: 1 for, -1 against, 0 abstains."""
    asked, pool, grams, (pk, pn, pl), _, wanted = _of_prompt(prompt)
    alnum, said, (rk, rn, rl), empty, refusal, truncated = (_of_reply if len(reply) <= REMEMBERED_CHARS else _of_reply.__wrapped__)(reply)
    out = {"empty": empty, "refusal": refusal}
    if alnum == 0 or not asked:
        out["copy"] = (-1, -1, -1)
    else:
        mine = [tuple(said[i : i + 3]) for i in range(max(1, len(said) - 2))]
        inside = sum(g in grams or g[0:1] == () for g in mine) / len(mine)
        new = sum(1 for w in said if w not in pool)
        cover = len(pool.intersection(said)) / len(pool)
        whole = said == asked or len(asked) and said[: len(asked)] == asked and all(w in pool for w in said)
        out["copy"] = (
            1 if whole else -1 if new > 2 else 0,
            1 if cover >= 0.6 and new == 0 else -1 if new > max(2, 0.2 * len(said)) else 0,
            1 if inside >= 0.75 and len(said) >= 3 and cover >= 0.4 else -1 if inside < 0.5 else 0,
        )
    if pk is None or rk is None:
        out["language"] = (-1 if rk is None else 0, 0, 0)
    else:
        off = rk not in wanted
        out["language"] = (1 if off else -1, (1 if off else -1) if rl >= 3 else 0, (1 if off else -1) if pl >= 2 and rn >= 3 else 0)
    return out | {"truncated": truncated}


class LabelModel:
    """How often each function is right when it votes, without (0) and with (1) the defect, and the defect's share."""

    def __init__(self, right: np.ndarray, share: float):
        self.right, self.share = right, share

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        up, down = (patterns > 0).astype(float), (patterns < 0).astype(float)
        against = np.log(1 - self.share) + down @ np.log(self.right[0]) + up @ np.log(1 - self.right[0])
        for_it = np.log(self.share) + up @ np.log(self.right[1]) + down @ np.log(1 - self.right[1])
        return 1 / (1 + np.exp(np.clip(against - for_it, -60, 60)))


def validated_cutoff(having: np.ndarray, lacking: np.ndarray, share: float) -> float:
    """The cutoff with the best F1 on posteriors of pairs known to have and to lack a defect of this share; amid equally good ones."""
    if not len(having) or not len(lacking):
        return 0.5
    edges = np.unique(np.concatenate([having, lacking, [0.0, 1.0]]))
    cutoffs = (edges[1:] + edges[:-1]) / 2
    recall = (having[None, :] >= cutoffs[:, None]).mean(1)
    wrong = (lacking[None, :] >= cutoffs[:, None]).mean(1)
    f1 = 2 * share * recall / np.maximum(share * recall + (1 - share) * wrong + share, 1e-12)
    best = cutoffs[f1 >= f1.max() - 1e-9]
    return float(best[np.abs(best - 0.5).argmin()])


def _fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """The label model of vote patterns, by EM over two classes with independent functions.

    An abstention says nothing. The prior (a function is right nine times in ten when it votes,
    one pair in fifty has the defect) weighs as much as a twentieth of the pairs, so that fits
    agree at every size.
    """
    n, weight = counts.sum(), 0.05 * counts.sum() + 1e-9
    up, down = (patterns > 0).astype(float), (patterns < 0).astype(float)
    right, share = np.full((2, patterns.shape[1]), 0.9), 0.02  # per class: how often a function that votes is right
    for _ in range(rounds):
        posterior = LabelModel(right, share).posterior(patterns)
        share = float((counts @ posterior + 0.02 * weight) / (n + weight))
        for c, mass, agree in ((0, counts * (1 - posterior), down), (1, counts * posterior, up)):
            strength = weight * (0.98 if c == 0 else 0.02)
            voted = mass @ (up + down)
            right[c] = np.clip((mass @ agree + 0.9 * strength) / (voted + strength), 0.02, 0.999)
    return LabelModel(right, share)


# Replies with a defect that is seeded, or that lack all others.
_REFUSALS = ("I'm sorry, but I can't help with that.", "I am not able to answer this question. Please ask a maintainer.", "Leider kann ich diese Frage nicht beantworten.", "Je suis désolé, je ne peux pas répondre à cette question.", "Lo siento, no puedo ayudar con eso.")
_SAID = {
    "en": "The value is read when the file is opened and it is written again at the end. You can change it in the list of the page.",
    "de": "Der Wert wird gelesen, wenn die Datei geöffnet ist, und am Ende wird er wieder in die Liste geschrieben.",
    "fr": "La valeur est lue quand le fichier est ouvert, puis elle est écrite dans la liste à la fin de la page.",
    "es": "El valor se lee cuando el archivo está abierto y después se escribe en la lista al final de la página.",
}


def seeded(prompt: str, reply: str, at: int) -> dict[str, str]:
    """Defect -> the reply with that defect and no other, where one can be made."""
    out = {"empty": ("", "…", " \n", "-", "?!")[at % 5], "refusal": _REFUSALS[at % len(_REFUSALS)]}
    own, named = _of_prompt(prompt)[3][0], _of_prompt(prompt)[4]
    if len(prompt.split()) >= 4:
        out["copy"] = prompt if at % 2 else "You asked: " + prompt
    if own is not None and not named:
        out["language"] = _SAID[sorted(k for k in _SAID if k != own)[at % 3]]
        words = _SAID[own].split()
        out["truncated"] = " ".join(words[: 5 + at % (len(words) - 8)]).rstrip(".,") + (" the", ",", " (", " and", "")[at % 5]
        out["refusal"] = {"de": _REFUSALS[2], "fr": _REFUSALS[3], "es": _REFUSALS[4]}.get(own, _REFUSALS[at % 2])
    return out


_VOTED = "prompt_id long, response_id long, seed string, " + ", ".join(f"{d} array<int>" for d in DEFECTS) + ", times long"


def _voted(messages: DataFrame) -> DataFrame:
    """Votes of all pairs (`seed` is null) and, counted by `times`, votes of all their prompts with replies that have the defect `seed`."""
    turns = ordered_turns(messages)
    pairs = turns.where("role = 'assistant' and prev_role = 'user'").select(F.col("prev_id").alias("prompt_id"), F.col("id").alias("response_id"), F.col("prev_content").alias("prompt"), F.col("content").alias("reply"))
    pairs = pairs.withColumn("at", F.pmod(F.xxhash64("prompt_id"), F.lit(1000)))
    columns = ["prompt_id", "response_id", "seed", *DEFECTS, "times"]

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Counter = Counter()  # vote patterns: as many as the functions allow, whatever the number of pairs
        for batch in batches:
            rows = []
            for p, r, a, b, at in zip(batch.prompt_id, batch.response_id, batch.prompt, batch.reply, batch["at"]):
                v = votes(a or "", b or "")
                rows.append((p, r, None, *(list(v[d]) for d in DEFECTS), 1))
                for seed, reply in seeded(a or "", b or "", at).items():
                    v = votes(a or "", reply)
                    known[(seed, *(v[d] for d in DEFECTS))] += 1
            yield pd.DataFrame(rows, columns=columns)
        rows = [(None, None, seed, *map(list, v), n) for (seed, *v), n in known.items()]
        yield pd.DataFrame(rows, columns=columns).astype({"prompt_id": "Int64", "response_id": "Int64"})

    return pairs.mapInPandas(vote, _VOTED)


def pair_defects(messages: DataFrame) -> DataFrame:
    """Defective pairs: `prompt_id`, `response_id`, `defects` (all kept, by rank), `defect` (the first), `posteriors`.

    A pair is an assistant turn right after a user turn. Null contents count as empty texts. No pair, no row.
    """
    from quarry.plans.scratch import written

    spark = messages.sparkSession
    voted = written(_voted(messages), "votes")
    own = voted.where("seed is null")
    posterior, kept = [], []
    for d in DEFECTS:
        rows = voted.groupBy("seed", d).agg(F.sum("times").alias("count")).collect()  # vote patterns: 3 to the number of functions at most, times the seeds
        real = [r for r in rows if r.seed is None]
        if not real:
            return spark.createDataFrame([], "prompt_id long, response_id long, defects array<string>, defect string, posteriors map<string,double>")
        model = _fit(np.array([r[d] for r in real]), np.array([float(r["count"]) for r in real]))
        told = {has: [(r[d], r["count"]) for r in rows if r.seed is not None and (r.seed == d) == has] for has in (True, False)}
        told = {has: np.repeat(model.posterior(np.array([v for v, _ in x])), [n for _, n in x]) if x else np.empty(0) for has, x in told.items()}
        cutoff = validated_cutoff(told[True], told[False], model.share)
        value = F.create_map(*[x for r, q in zip(real, model.posterior(np.array([r[d] for r in real]))) for x in (F.lit(",".join(map(str, r[d]))), F.lit(float(q)))])
        posterior.append(value[F.array_join(F.col(d).cast("array<string>"), ",")].alias(d))
        kept.append(F.when(posterior[-1] >= cutoff, F.lit(d)))
    defects = F.array_compact(F.array(*kept))
    out = own.select("prompt_id", "response_id", defects.alias("defects"), F.create_map(*[x for d, p in zip(DEFECTS, posterior) for x in (F.lit(d), F.round(p, 6))]).alias("posteriors"))
    return out.where(F.size("defects") > 0).withColumn("defect", F.col("defects")[0])
