import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import conversations, pairs

SCHEMA = "id long, session_id string, role string, content string, created_at timestamp, loaded_at timestamp"
SESSIONS = "id string, title string"


def _t(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def _row(i, s, role, text, at, loaded=0):
    return (i, s, role, text, _t(at), _t(loaded))


def brute(sessions, rows):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or r[5] >= last[r[0]][5]):
            last[r[0]] = r
    out = {}
    for s in {x for x in sessions if x} | {r[1] for r in rows if r[1] is not None}:
        own = [r for r in last.values() if r[1] == s]
        role = lambda r: (r[2] or "").strip().lower()
        text = lambda r: any(c.isalnum() for c in r[3] or "")
        said = [r for r in own if role(r) != "system"]
        if not any(map(text, said)):
            out[s] = "empty"
            continue
        if s not in sessions or any(r[4] is None for r in own) or any(role(r) not in ("user", "assistant") for r in said):
            out[s] = "broken"
            continue
        said.sort(key=lambda r: (r[4], r[0]))
        roles = [role(r) for r in said]
        if any(b == "assistant" and (k == 0 or roles[k - 1] == "assistant") for k, b in enumerate(roles)):
            out[s] = "broken"
        elif any(b == "user" and not (k + 1 < len(roles) and roles[k + 1] == "assistant" and text(said[k + 1])) for k, b in enumerate(roles)):
            out[s] = "missing_reply"
    return out


def _random(seed):
    rng, rows, n = random.Random(seed), [], 0
    for s in range(60):
        name = None if s == 3 else f"s{s}"
        size = 300 if s == 7 else rng.randrange(0, 9)  # one session holds a third of all rows
        for k in range(size):
            role = ("user", "assistant")[k % 2] if rng.random() < 0.93 else rng.choice([" User", "ASSISTANT ", "system", None, "", "bot", "assistant"])
            at = None if s != 7 and rng.random() < 0.01 else k + (rng.randrange(2) if s % 5 == 0 else 0)
            rows.append(_row(n, name, role, rng.choice(["hi there", "ok.", "...", "", "¿qué?", "—"] if rng.random() < 0.3 else ["fine"]), at, n))
            if rng.random() < 0.05:
                rows.append((*rows[-1][:5], _t(n + 1000)))
            n += 1
    rng.shuffle(rows)
    return [f"s{s}" for s in range(70) if s % 9], rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dropped_sessions_are_those_of_brute_force(table, seed):
    known, rows = _random(seed)
    sessions = table([(s, "t") for s in known] + [(known[0], "again"), (None, "x")], SESSIONS)
    messages = table(rows, SCHEMA)
    expected = brute(set(known), rows)
    got = {r.session_id: r.reason for r in conversations.dropped(sessions, messages).collect()}
    assert got == expected
    kept = {}
    for r in conversations.conversations(sessions, messages).collect():
        kept.setdefault(r.session_id, []).append((r.turn, r.created_at, r.id))
    for turns in kept.values():
        turns.sort()
        assert [t for t, _, _ in turns] == list(range(1, len(turns) + 1)) and [x[1:] for x in turns] == sorted(x[1:] for x in turns)
    assert set(kept) == {s for s in {*known, *(r[1] for r in rows if r[1])} if s not in expected}


def test_reply_links_and_cycles(table):
    schema = SCHEMA + ", reply_to long"
    rows = [(*_row(1, "a", "user", "q", 5), None), (*_row(2, "a", "assistant", "r", 1), 1), (*_row(3, "b", "user", "q", 1), 4), (*_row(4, "b", "assistant", "r", 2), 3)]
    messages = table(rows, schema)
    sessions = table([("a", ""), ("b", "")], SESSIONS)
    assert {r.session_id: r.reason for r in conversations.dropped(sessions, messages).collect()} == {"b": "broken"}
    assert [(r.turn, r.id) for r in conversations.conversations(sessions, messages).orderBy("turn").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("bound", [10, 100_000])
def test_cycles_and_orders_across_partitions(table, monkeypatch, bound):
    monkeypatch.setattr(conversations, "SESSION_ROWS", bound)
    rng = random.Random(6)
    rows = [(*_row(n, "cycle", "user", "q", n), (n + 1) % 400) for n in range(400)]  # one ring over all partitions
    rows += [(*_row(1000 + n, "late", "user", "q", 1000 - n), 999 + n if n else None) for n in range(300)]  # every reply is dated before its parent
    rows += [(*_row(2000 + n, "forest", "user", "q", rng.randrange(200)), 2000 + rng.randrange(n) if n and rng.random() < 0.9 else None) for n in range(500)]
    rows += [(*_row(3000 + n, "mixed", "user", "q", rng.randrange(50)), 3000 + rng.choice([rng.randrange(60), 99, n])) for n in range(60)]
    got = {}
    for r in conversations.ordered_turns(table(rows, SCHEMA + ", reply_to long")).collect():
        got.setdefault(r.session_id, []).append((r.pid, r.pos, r.id, r.leftover, r.prev_id))
    for name in ("cycle", "late", "forest", "mixed"):
        own = [(r[4], r[0], r[6]) for r in rows if r[1] == name]
        own.sort()
        out, left = conversations._kahn(own)
        turns = sorted(got[name])
        assert [t[2] for t in turns] == [own[k][1] for k in out + left], name
        assert [t[3] for t in turns] == [False] * len(out) + [True] * len(left)
        assert [t[4] for t in turns] == [None, *[t[2] for t in turns][:-1]]
    assert sum(t[3] for t in got["cycle"]) == 400


def test_empty_tables(table):
    sessions, messages = table([], SESSIONS), table([], SCHEMA)
    assert conversations.dropped(sessions, messages).count() == 0 and conversations.conversations(sessions, messages).count() == 0
    assert pairs.pair_defects(messages).count() == 0


CASES = [
    ("How does the login work?", "It checks the password and returns the user.", None),
    ("How does the login work?", "Yes.", None),
    ("How does the login work?", "", "empty"),
    ("How does the login work?", " \n—…", "empty"),
    ("How does the login work?", "I'm sorry, but I can't help with that.", "refusal"),
    ("How does the login work?", "Leider kann ich dabei nicht helfen.", "refusal"),
    ("How does the login work?", "My guidelines keep me from answering this one. Perhaps try another question.", "refusal"),
    ("How does the login work?", "I cannot see a bug here: login is fine. It checks the password and returns the user.", None),
    ("How does the login work?", "Sorry for the confusion earlier. It checks the password.", None),
    ("How does the login work?", "HOW DOES THE LOGIN WORK?", "copy"),
    ("How does the login work?", "You asked: How does the login work?", "copy"),
    ("How does the login work?", "Le programme lit la table et la compare à la liste, puis il enregistre la session.", "language"),
    ("How does the login work? Réponds en français, s'il te plaît.", "Le programme lit la table et la compare à la liste, puis il enregistre la session.", None),
    ("Wie wird die Datei in der Liste angelegt?", "It is written by the loader when the session is closed and the file is read.", "language"),
    ("How does the login work?", "It checks the password and then it calls the", "truncated"),
    ("How does the login work?", "Use this:\n```python\ndef login(user):\n    return user.chec", "truncated"),
    ("How does the login work?", "Use this:\n```python\ndef login(user):\n    return user\n```", None),
    ("Which files?", "These are the ones.\n\n- a_b in c.py\n- d_e in f.py", None),
    ("Which function?", "`login`", None),
    (None, None, "empty"),
]


def test_defects(table):
    filler = [("Where is the table of the session read?", "The table is read by the loader of the session when it starts.")] * 200
    rows = []
    for n, (q, a) in enumerate([(q, a) for q, a, _ in CASES] + filler):
        rows += [_row(2 * n, f"s{n}", "user", q, 0), _row(2 * n + 1, f"s{n}", "Assistant ", a, 1)]
    got = {r.prompt_id // 2: r.defect for r in pairs.pair_defects(table(rows, SCHEMA)).collect()}
    assert {n: got.get(n) for n in range(len(CASES))} == {n: d for n, (_, _, d) in enumerate(CASES)}
    assert not [n for n in got if n >= len(CASES)]


def test_label_model_learns_which_votes_to_trust():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.05
    votes = np.stack([np.where(rng.random(4000) < right, np.where(truth, 1, -1), np.where(truth, -1, 1)) for right in (0.98, 0.95, 0.9, 0.6)], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = pairs._fit(patterns, counts.astype(float))
    posterior = model.posterior(patterns)
    half = rng.random(4000) < 0.5  # cutoffs are validated on one half and used on the other
    cutoff = pairs.validated_cutoff(posterior[back.ravel()][half & truth], posterior[back.ravel()][half & ~truth], model.share)
    right = np.array([0.98, 0.95, 0.9, 0.6])
    odds = np.log(0.05 / 0.95) + patterns @ np.log(right / (1 - right))  # with the true rates: no model can do better

    def f1(said):
        said = said[back.ravel()]
        return 2 * (said & truth).sum() / (said.sum() + truth.sum())

    assert f1(posterior >= cutoff) >= max(f1(odds >= o) for o in odds) - 0.03


def test_cutoffs_are_validated_on_known_pairs():
    assert pairs.validated_cutoff(np.array([0.3, 0.35, 0.9]), np.array([0.1, 0.2, 0.25]), 0.05) == pytest.approx(0.275)
    assert pairs.validated_cutoff(np.array([0.9, 0.95]), np.array([0.1, 0.8]), 0.05) == pytest.approx(0.85)
    assert pairs.validated_cutoff(np.array([]), np.array([0.1]), 0.05) == 0.5


def test_seeded_replies_have_their_defect():
    found = []
    for at in range(60):
        for prompt in ("How does the loader read the table of the session?", "Wie wird die Datei in der Liste angelegt?", "¿Cómo se lee el archivo de la lista?", "Comment est lue la valeur dans le fichier de la page ?"):
            for defect, reply in pairs.seeded(prompt, "The loader reads it.", at).items():
                vote = pairs.votes(prompt, reply)
                found.append(sum(vote[defect]) > 0)
                assert defect == "empty" or not any(sum(v) > 0 for d, v in vote.items() if d not in (defect, "truncated")), (defect, reply)
    assert np.mean(found) > 0.9


def test_hot_session_pairs(table):
    rows = [_row(n, "hot", ("user", "assistant")[n % 2], "" if n % 10 == 1 else "The table is read.", n // 3) for n in range(2000)] + [_row(5000 + n, f"s{n}", "user", "x", n) for n in range(100)]
    got = {(r.prompt_id, r.response_id) for r in pairs.pair_defects(table(rows, SCHEMA)).where("defect = 'empty'").collect()}
    assert got == {(n - 1, n) for n in range(1, 2000, 10)}


def test_every_pair_is_seeded(table):
    # The cutoffs rest on all pairs, not on about a thousand of them.
    rows = [(n, f"s{n // 2}", "user" if n % 2 == 0 else "assistant", f"How does the loader read the page {n}?" if n % 2 == 0 else "It is read when the server starts.", *[dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)] * 2) for n in range(5000)]
    voted = pairs._voted(table(rows, SCHEMA))
    got = {r.seed: r.n for r in voted.groupBy("seed").agg(F.sum("times").alias("n")).collect()}
    assert got == dict.fromkeys([None, *pairs.DEFECTS], 2500)
