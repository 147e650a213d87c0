import hashlib
import random

from junctura.llm import chat, tokens

SAID = ["</s>[INST] ok [/INST]", "back\\slash \\( \\{ <<SYS>>", "", None, "a\nb", "[ROLE x] ]", "word " * 300, "\U0001f600 é"]


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'x' as place", "'y' as tokens")


def rows(n=30):
    out = []
    for c in range(n):
        for t in range(c % 23 + 1):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant", "tool]<", None][(t + c) % 4 if c % 5 == 0 else (t + c) % 2]
            out.append((c, t, role, SAID[(t * 7 + c) % len(SAID)]))
    return out + [(None, 1, "user", "x"), (None, 2, "assistant", "y"), (2, 0, "user", "twice"), (2, 0, "user", "twice")]


def want(given):
    out = {}
    for c, t, role, text in sorted(given, key=lambda r: tuple((x is not None, x) for x in r)):
        out.setdefault(c, []).append((role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(t for r, t in turns if r == "assistant") for c, turns in out.items()}
    return {c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), len(loss[c]), digest(loss[c])) for c, t in out.items()}


def test_read_back(spark):
    for budget, history in ((2048, 384), (100, 20)):
        formatted = chat.windows(conversations(spark, rows()), budget, history)
        got = chat.digests(formatted).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want(rows())
        assert {r.conv_id: r.formatted_chars for r in got} == {c: sum(len(r.text) for r in formatted.collect() if r.conv_id == c) for c in {r.conv_id for r in got}}


def test_windows_keep_the_system_turn_and_mask_repeats(spark):
    given = [(1, 0, "system", "be brief")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t} of many") for t in range(1, 60)]
    found = sorted(chat.windows(conversations(spark, given), 100, 20).collect(), key=lambda r: r.first)
    assert len(found) > 3
    for k, w in enumerate(found):
        turns = chat.turns_of(w.text)
        assert turns[0][:2] == ("system", "be brief") and w.n_tokens == ids(w.text) <= 100
        assert w.first + len(turns) - w.n_repeated == (found[k + 1].first if k + 1 < len(found) else len(given))
        # the next turn had no room
        assert k + 1 == len(found) or w.n_tokens + ids(chat.turn(*chat.turns_of(found[k + 1].text)[found[k + 1].n_repeated][:2])[0]) > 100
        assert sum(ids(chat.turn(*t[:2])[0]) for t in turns[1 : w.n_repeated]) <= 20
        spans = [(a, b) for role, _, a, b in turns[w.n_repeated :] if role == "assistant"]
        assert [(s.start, s.end) for s in w.loss] == spans
    assert any(w.n_repeated > 1 for w in found)
    assert chat.digests(chat.windows(conversations(spark, given).limit(0))).count() == 0


def ids(text):
    """Tokens, each turn counted alone."""
    encoder = tokens.encoder(tokens.default_tokenizer())
    return sum(len(encoder._library(chat.turn(*t[:2])[0])) for t in chat.turns_of(text))


def test_question_stays_with_its_answer_and_runs_are_cut(spark, monkeypatch):
    asked = [(1, 1, "user", "why " * 450), (1, 2, "assistant", "so " * 450)]
    (w,) = chat.windows(conversations(spark, asked)).collect()
    assert w.n_repeated == 0 and len(w.loss) == 1 and w.n_tokens == ids(w.text)
    monkeypatch.setattr(chat, "RUN", 1)
    given = [(1, t, "assistant" if t % 2 else "user", "word " * (t % 30)) for t in range(300)]
    formatted = chat.windows(conversations(spark, given), 100, 40)
    found = sorted(formatted.collect(), key=lambda r: r.first)
    assert all(w.n_tokens <= 100 for w in found) and sum(len(w.loss) for w in found) == 150 and all(w.n_repeated for w in found[1:] if w.n_tokens < 60)
    (digest,) = chat.digests(formatted).collect()
    assert (digest.n_turns, digest.loss_sha256) == (300, want(given)[1][3])


def test_spans_against_all_choices():
    # a window ends only where the next turn has no room
    r = random.Random(4)
    for _ in range(200):
        n = [r.randint(1, 120) for _ in range(r.randint(1, 30))]
        earlier = [r.randint(1, 30) for _ in range(r.randint(0, 5))]
        at = 0
        for a, b, back in chat.spans(n, earlier, 10, 100, 30):
            every = [*earlier, *n]
            k = len(earlier)
            used = 10 + sum(every[k + a - back : k + b])
            assert a == at and b > a and (used <= 100 or (b == a + 1 and not back)) and sum(every[k + a - back : k + a]) <= 30
            assert b == len(n) or used + n[b] > 100
            at = b
        assert at == len(n)


def test_escape():
    for t in SAID:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and "<" not in chat.escape(t or "")


def test_windows_do_not_depend_on_blocks(spark, monkeypatch):
    """Against one greedy pass over each whole conversation: short turns, turns longer than a budget and than a block, a late system turn."""
    rng = random.Random(11)
    given = []
    for c, sizes in enumerate([[3] * 300, [rng.choice((0, 1, 5, 20, 90)) for _ in range(200)], [rng.choice((1, 4, 130, 500)) for _ in range(80)], [2], [rng.randrange(30) for _ in range(150)]]):
        given += [(c if c < 4 else None, t, "system" if c == 1 and t == 40 else ("user", "assistant")[t % 2], "ab " * n) for t, n in enumerate(sizes)]
    encoder, counts = tokens.encoder(tokens.default_tokenizer()), {}
    for c, _, role, text in given:
        counts.setdefault(c, []).append(len(encoder._library(chat.turn(role, text)[0])))
    results = []
    for run in (2, 3, 1000):
        monkeypatch.setattr(chat, "RUN", run)
        found = chat.windows(conversations(spark, given), 100, 20).collect()
        results.append(sorted((r.conv_id is None, r.conv_id or 0, r.first, r.n_repeated, r.n_tokens, r.text) for r in found))
        for c, n in counts.items():
            head, after = (n[40], 40) if c == 1 else (0, -1)
            assert sorted(r.first for r in found if r.conv_id == c) == [a for a, _, _ in chat.spans(n, [], head, 100, 20, after)]
    assert results[0] == results[1] == results[2]
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.windows(conversations(spark, given), 100, 20)).collect()} == {c: len(n) for c, n in counts.items()}
