"""The corpus operators against plain versions, on odd rows and on a shared table."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from geospan.llm import bpe, chat, licenses, minhash, mixing, pii, quality, queries, repeats, secrets, suffixes, vectors
from geospan.llm.common import lower_ascii
from geospan.llm.components import components
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"
LONG = "word " * 30000
ODD = [
    (None, "text without id"), (1, None), (2, ""), (3, " \n\t "), (4, "short"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (6, "a b c d e f g h"), (7, LONG), (8, "x" * 100_000), (9, "été 漢字 😀  \x1c end"), (10, "a b c d e f g h i"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with inner ones."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("id", "key", "n", "band", "component", "block", "shard", "a", "b", "_id", "_text", "names")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


DIGESTS = {
    "pii": pii.pii_digest, "secrets": secrets.secrets_digest, "licenses": licenses.license_digest, "bpe": bpe.encode_digest, "quality": lambda df: quality.quality(df, quality.Field.prior()),
    "minhash": minhash.near_duplicates, "repeats": repeats.repeated_bytes,
}


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_odd_rows_and_empty_tables(odd, empty, name):
    found = DIGESTS[name](odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in ODD)
    assert DIGESTS[name](empty).collect() == []


# 1 ---------------------------------------------------------------------------------------------------------------------


def plain_pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20\-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_spans(documents):
    rng = random.Random(1)
    made = ["".join(rng.choice("a@.1-2 3+(4)5é%") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    made += ["1.2.3.4.5.6.7.8 x@y.z@a.b", "4111 1111 1111 1111", "a@b.c." + "9" * 3000 + ".1.1.1", "+1 (499) 555-6503"]
    for text in [*made, *(t for _, t in texts(documents))]:
        assert [(k, s, e) for s, k, e, _ in pii.find(text) if k in pii.KINDS[:4]] == plain_pii(text)


def test_account_numbers():
    """Followed by capitals, by a known or unknown country's size, in groups or not."""
    spans = lambda t: [t[s:e] for s, k, e, _ in pii.find(t) if k == "iban"]
    assert spans("GB82 WEST 1234 5698 7654 32 OK THEN") == ["GB82 WEST 1234 5698 7654 32"]
    assert spans("IBAN: GB82WEST12345698765432 BIC DEUTDEFF and NO9386011117947.") == ["GB82WEST12345698765432", "NO9386011117947"]
    assert spans("GB82WEST123456987654320") == [] and spans("GB82WEST1234569876543") == []
    body = "12345678901234567"
    check = 98 - int("".join(str(int(c, 36)) for c in body + "ZZ00")) % 97
    assert spans(f"x ZZ{check:02d}{body} Y") == [f"ZZ{check:02d}{body}"]


def test_pii_added_spans():
    kinds = lambda t: [k for _, k, _, _ in pii.find(t)]
    assert kinds("our account GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("our account GB83 WEST 1234 5698 7654 32 please") == []
    assert kinds("ssn 078-05-1120") == ["national"] and kinds("part 078-05-1120") == []
    assert kinds("call 415-555-0132") == ["number"]
    assert pii.score("contact a@b.c", "email", 8, 13) > pii.score("xxxxxxx a@b.c", "email", 8, 13)


# 2 ---------------------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    found = [("assign", *m.span()) for m in re.finditer(r"((?ia:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


@pytest.fixture(scope="module")
def scorer():
    return secrets.Scorer(secrets.labelled())


def test_secret_base_spans(documents, scorer):
    rng = random.Random(2)
    parts = ["token", "API_KEY", "secret", '="', ": ", " ", "0a1b2c3d4e5f6a7b", "AKIA", "ABCD1234EFGH5678", "é", "zz.-_", "password"]
    for text in [*("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)), *(t for _, t in texts(documents))]:
        assert [(k, s, e) for s, k, e, _ in secrets.find(text, scorer) if k != "token"] == plain_secrets(text)


def test_inferred_formats_hold_out(scorer):
    """Recall and the format named, for all formats; lengths, states and prefixes are learnt; ordinary words are not."""
    fresh = secrets.labelled(100, seed=99)
    for name, examples in fresh.items():
        found = [scorer.score(x) for x in examples]
        assert sum(v >= secrets.LEAST for v, _ in found) / len(found) > 0.95 and sum(n == name for _, n in found) / len(found) > 0.95
    states = {name: len(automaton.states) for name, (_, automaton) in scorer.formats.items()}
    assert states["code_host"] == len("ghp_") + 36 + 1 and states["cloud_access"] == 21 and states["digest"] == 65 and states["web_token"] <= 25 and states["base64_key"] <= 45
    assert {name: prefix for name, (prefix, _) in scorer.formats.items() if prefix} == {"chat_bot": "xoxb-", "cloud_access": "AKIA", "cloud_session": "ASIA", "code_host": "ghp_", "code_host_lab": "glpat-", "maps": "AIza", "payment": "sk_live_", "web_token": "eyJ"}
    for name in ("cloud_access", "cloud_session", "code_host", "code_host_lab", "chat_bot", "payment"):
        automaton = scorer.formats[name][1]
        assert all(automaton.log_likelihood(x) > -1000 and automaton.log_likelihood(x[:-1]) == automaton.log_likelihood(x + "A") == float("-inf") for x in fresh[name])
    assert scorer.formats["code_host"][1].log_likelihood("ghp_" + "aB3" * 6 + "xy") == float("-inf")
    words = ["internationalization", "thethationandwhingreousthere", "/usr/local/share/documents/", "snake_case_function_name", "2024-01-05_report-final"]
    assert not any(scorer.score(w)[0] >= secrets.LEAST for w in words)


def test_long_credentials(scorer):
    """Tokens and keys of any length, and credentials within long runs."""
    rng = random.Random(16)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for size in (4000, 4097, 40_000):
        token = "eyJ" + "".join(rng.choice(letters + "_-") for _ in range(size - 3))
        key = "".join(rng.choice(letters + "+/") for _ in range(size))
        words = "the_long_name_of_a_file_" * (size // 24)
        assert scorer.score(token)[0] >= secrets.LEAST and scorer.score(key)[0] >= secrets.LEAST
        for value in (token, key, "ghp_" + key[:36].replace("+", "0").replace("/", "1")):
            text = f"x {words}={value} y"
            assert any(kind == "token" and s <= len(words) + 3 and e == len(text) - 2 for s, kind, e, _ in secrets.find(text, scorer))


def brute_spans(scorer, text):
    """Each format, start and end tried; ``text`` is one run."""
    found, out, joints = [], [], "+/=_-"
    for p, automaton in scorer.formats.values():
        done = 0
        for s in range(len(text)):
            if s >= done and (text.startswith(p, s) if p else s == 0 or text[s - 1] in joints):
                ends = [e for e in range(s + 16, len(text) + 1) if e == len(text) or text[e] in joints]
                far = max((e for e in ends if automaton.log_likelihood(text[s:e]) - sum(scorer.ordinary.of_run(text[s:e])) >= secrets.LEAST), default=0)
                found, done = (found + [(s, far)], far) if far else (found, done)
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def test_embedded_credentials(scorer):
    """Credentials behind a name and '=', in a path, behind a base span, and in front of more text are found as a whole."""
    fresh = secrets.labelled(20, seed=98)
    hits, total = 0, 0
    for name, examples in fresh.items():
        for x in examples if name != "digest" else ():
            if secrets.base_spans(x) or scorer.score(x)[0] < secrets.LEAST:
                continue
            for before, after in (("GITHUB_PAT=", ""), ("url?x=", ""), ("SLACK=", "="), ("https://host/", "/x"), ("name_", ""), ("in-", ""), ("zz" if scorer.formats[name][0] else "zz=", ""), ("0123456789abcdef01/", "")):
                text = before + x + after
                spans = [(s, e) for s, kind, e, _ in secrets.find(f"see {text} here", scorer) if kind == "token"]
                total += 1
                hits += any(s <= 4 + len(before) and e >= 4 + len(before) + len(x) for s, e in spans)
    assert total > 800 and hits == total


def test_spans_as_brute_force(scorer):
    rng = random.Random(15)
    fresh = [x for examples in secrets.labelled(5, seed=97).values() for x in examples]
    parts = ["ghp_", "eyJ", "AIza", "/", "=", "-", "_", "+", "documents", "Name", "x", "20240105", "sk_live_", "AKIA"]
    for _ in range(150):
        text = "".join(rng.choice(fresh if rng.random() < 0.25 else parts) for _ in range(rng.randint(1, 7)))
        assert [(s, e) for s, e, _ in scorer.spans(text)] == brute_spans(scorer, text)


def test_background(spark, scorer):
    """Pairs of characters counted over all texts, as a plain count has them; found secrets are the formats', not words."""
    made = ["ab=cd 12", "", None, "é_x" * 400_000, "z", "AB"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], "doc_id long, text string, pair string").repartition(2)
    counts = np.zeros((len(secrets.LETTERS) + 1,) * 2)
    for text in made:
        for b, c in zip(" " + (text or ""), text or "", strict=False):
            if c in secrets.LETTERS:
                counts[secrets._PLACE.get(b, 0), secrets._PLACE[c]] += 1
    assert np.allclose(np.array(secrets.background(df).logs), np.array(secrets.Background.of(counts).logs))
    assert secrets.background(df.limit(0)).logs == secrets.Background.prior().logs
    table = spark.createDataFrame([("f", f"pre-{i:020d}") for i in range(50)] * 2 + [("f", None), (None, "x")], "format string, credential string")
    known = secrets.examples_of(table, 40)
    assert set(known) == {"f"} and len(set(known["f"])) == 40
    text = "see pre-" + "1234567890" * 2 + " and internationalization-of-things"
    rows = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), table).collect()
    assert [(r.kind, text[r.start : r.end]) for r in rows] == [("hex", "1234567890" * 2)] or [(r.kind, text[r.start : r.end]) for r in rows] == [("token", "pre-" + "1234567890" * 2)]


def test_automaton_merges():
    automaton = secrets.Automaton(["ab" * n for n in range(1, 30) for _ in range(20)], classes=lambda c: c)
    assert len(automaton.states) < 10 and automaton.log_likelihood("abab") > -20 and automaton.log_likelihood("ba") == float("-inf")


def test_redaction(spark):
    df = spark.createDataFrame([(1, "x token = 0123456789abcdef01 y", "en", "s", 3), (2, None, None, None, None), (3, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert found[1].text == "x [secret] y" and found[1].n_chars == len("x [secret] y") and found[2].text is None and found[3].text == "clean"


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip():
    rng = random.Random(3)
    parts = ["<|im_end|>", "<|im_start|>", "<*|", "<**|x", "\n", "assistant", "<", "|", "*", "\\n", "é"]
    for _ in range(500):
        turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 3))) if rng.random() < 0.3 else rng.choice(["user", "assistant"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        formatted, mask = chat.render(turns)
        assert chat.read_back(formatted) == turns
        assert [chat.unescape(formatted[s:e]) for s, e in mask] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    nodes = [("t", "1", None, "user", "q", 0.0), ("t", "2", "1", "assistant", "bad", 1.0), ("t", "3", "1", "assistant", "good", 5.0), ("t", "4", "3", "user", "more", None), ("u", "8", "9", "user", "circle", 0.0), ("u", "9", "8", "user", "circle", 0.0), ("v", "7", "gone", "assistant", None, 0.0)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    best = {r.tree: r for r in chat.conversations(df).collect()}
    assert chat.read_back(best["t"].formatted) == [("user", "q"), ("assistant", "good"), ("user", "more")]
    assert set(best) == {"t", "v"}
    assert sorted(r.leaf for r in chat.conversations(df, best=None).collect()) == ["2", "4", "7"]


def test_trees_with_equal_ids(spark):
    """Trees that use the same ids, repeated messages, null ids."""
    nodes = [("t", "1", None, "user", "q"), ("t", "1", None, "user", "q"), ("t", "2", "1", "assistant", "a"), ("u", "1", None, "user", "other"), ("u", "2", "1", "assistant", "b"), ("u", "3", "2", "user", "c"), (None, "1", None, "user", "z"), ("w", None, None, "user", "n")]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string").withColumn("score", F.lit(None).cast("double"))
    found = {(r.tree, r.leaf): chat.read_back(r.formatted) for r in chat.conversations(df, best=None).collect()}
    assert found == {("t", "2"): [("user", "q"), ("assistant", "a")], ("u", "3"): [("user", "other"), ("assistant", "b"), ("user", "c")], ("", "1"): [("user", "z")], ("w", ""): [("user", "n")]}


def test_deep_chain(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", str(i)) for i in range(300)], "conv_id long, turn long, role string, text string")
    row = chat.chat_digest(chat.conversations(chat.as_messages(turns))).first()
    assert row.n_turns == 300 and row.loss_sha256 == hashlib.sha256("".join(str(i) for i in range(0, 300, 2)).encode()).hexdigest()


def test_odd_conversations(spark):
    turns = spark.createDataFrame([(None, 1, "user", "a"), (2, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.chat_digest(chat.conversations(chat.as_messages(turns))).collect()}
    assert found[None].n_turns == 1 and found[2].n_turns == 3 and found[2].loss_chars == 2
    assert chat.chat_digest(chat.conversations(chat.as_messages(turns.limit(0)))).collect() == []


# 4 ---------------------------------------------------------------------------------------------------------------------


def plain_components(sets, percent=85):
    inverted, parent = defaultdict(list), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sorted(sets.items()):
        shared = Counter(j for x in s for j in inverted[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(i)
    return {i: find(i) for i in sets}


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower_ascii(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(spark, documents):
    """The shared table and a family of copies of one text, of which many are nearer to others than to the first."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    made = []
    for k in range(160):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 99999)}"
        made.append((10_000 + k, " ".join(copy)))
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    sets = {i: plain_set(t) for i, t in texts(df)}
    wanted = plain_components(sets)
    found = minhash.near_duplicates(df).collect()
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in found)


def test_odd_near_duplicates(odd):
    found = minhash.near_duplicates(odd).collect()
    by_id = {r.doc_id: r for r in found}
    assert by_id[6].component_id == 5 and by_id[10].component_id == 10 and by_id[None].component_id is None and by_id[None].kept
    assert by_id[1].n_shingles == by_id[3].n_shingles == 0 and by_id[4].n_shingles == 1 and by_id[7].n_shingles == 1
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 32))
    near = np.concatenate([base[:60] + 0.12 * rng.normal(size=(60, 32)) for _ in range(5)])
    hot = base[0] + 0.05 * rng.normal(size=(120, 32))
    x = np.concatenate((base, near, hot, base[5:8]))
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [float("nan")] * 32, 1), (9003, [None] * 32, 1), (9004, [], 1), (9005, [1.0, 2.0], 1), (None, x[0].tolist(), 1), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, key int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    found = vectors.near_vectors(df).collect()
    assert len(found) == len(data)
    got = {r.vec_id: r for r in found}
    counts = linked.sum(1)
    assert all(got[i].n_links <= counts[i] for i in range(len(x)))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.97 * counts.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(9000, 9006)) and got[None].component_id is None
    assert got[len(x) - 1].component_id == got[7].component_id
    assert vectors.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("common", [0.0, 2.0])
def test_vectors_near_the_threshold(spark, common):
    """Recall of links of cosine 0.90 to 0.92, without and with a direction that all vectors share (cosines of 0.8 between strangers)."""
    rng = np.random.default_rng(19)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(unit(rng.normal(size=(3000, 64))) + common * unit(rng.normal(size=(1, 64))))
    y = rng.normal(size=(3000, 64))
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    t = rng.uniform(0.901, 0.92, size=(3000, 1))
    both = np.concatenate((x, t * x + np.sqrt(1 - t * t) * y))
    linked = both @ both.T >= 0.9
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    assert all(got[i] <= n for i, n in enumerate(linked.sum(1).tolist()))
    assert sum(got.values()) >= 0.98 * linked.sum()


def test_vectors_by_brute_force(spark):
    """Ids with several vectors, equal vectors, groups large enough for blocks and tiles: links and components as brute force has them."""
    rng = np.random.default_rng(20)
    base = rng.normal(size=(40, 8))
    hot = rng.normal(size=8) + 0.1 * rng.normal(size=(1500, 8))
    data = [(i, v) for i, v in enumerate(base)] + [(100 + i, v) for i, v in enumerate(hot)]
    data += [(7, base[8]), (7, base[9]), (7, base[9]), (50, base[8]), (51, base[8] * 2), (52, hot[0]), (53, hot[1]), (53, base[3]), (54, base[3] * 1.0001)]
    units = np.array([v / np.linalg.norm(v) for _, v in data])
    linked, ids = units @ units.T >= 0.9 - 1e-12, np.array([i for i, _ in data])
    parent = {i: i for i in ids.tolist()}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(*np.nonzero(linked), strict=True):
        x, y = find(int(ids[a])), find(int(ids[b]))
        parent[max(x, y)] = min(x, y)
    wanted = Counter((int(ids[a]), len(set(ids[linked[a]].tolist()) - {int(ids[a])}), find(int(ids[a]))) for a in range(len(data)))
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in data], "vec_id long, embedding array<double>, v int")
    got = vectors.near_vectors(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == wanted


# 6 ---------------------------------------------------------------------------------------------------------------------


def plain_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(documents):
    field = quality.Field.prior()
    for text in [*(t for _, t in texts(documents)), "a b c a b c", "x\nx\n\nx", *(t or "" for _, t in ODD[:-3])]:
        found = quality.judge(text, field)
        assert found[:5] == plain_quality(text)
        assert found[5] == (found[0] < 50 or 100 * found[4] > 50 * found[0]) and not (found[5] and found[6])


def test_viterbi_is_best():
    rng = np.random.default_rng(7)
    field = quality.Field(rng.normal(size=(2, 3)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 7):
        x = rng.normal(size=(n, 3))
        score = lambda y: field.start[y[0]] + sum(field.emit[y[i]] @ x[i] for i in range(len(y))) + sum(field.move[y[i - 1], y[i]] for i in range(1, len(y)))  # noqa: B023, E731
        every = [tuple(map(int, np.binary_repr(k, n))) for k in range(2**n)]
        assert tuple(field.viterbi([tuple(r) for r in x])) == max(every, key=score)


def test_line_labels(spark):
    """Lines from all over long documents; a field fitted on turns finds a block of boilerplate inside content."""
    assert quality.evenly(list(range(50))) == list(range(50))
    some = quality.evenly(list(range(1000)))
    assert len(some) == 64 and some[0] == 0 and some[-1] == 999 and sum(b - a == 1 for a, b in zip(some, some[1:], strict=False)) == 60
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    good = lambda n: [" ".join(word() for _ in range(9)) + "." for _ in range(n)]
    bad = lambda n: [" ".join(word().upper() + "!!" for _ in range(9)) for _ in range(n)]
    docs = [(i, "\n".join(good(30) if i % 2 else bad(30)), i % 2) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(90, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(0, 0), (None, 1), (90, 1), (91, None)], "doc_id long, quality int")
    field = quality.train(df, labels)
    assert field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0]
    mixed = good(12) + bad(8) + good(12)
    assert field.viterbi(quality.lines_of("\n".join(mixed).encode())[0]) == [0] * 12 + [1] * 8 + [0] * 12


def test_quality_on_labelled_documents(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    field = quality.train(documents, labels)
    kept = {r.doc_id: r.kept for r in quality.quality(documents, field).where("NOT base_failed").collect()}
    told = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in kept}
    good = [kept[i] for i, y in told.items() if y == 1]
    bad = [kept[i] for i, y in told.items() if y == 0]
    assert sum(good) >= 0.97 * len(good) and (not bad or sum(bad) <= 0.5 * len(bad))
    assert quality.train(documents, labels.limit(0)).emit.tolist() == quality.Field.prior().emit.tolist()


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_license_base(documents):
    scanner = licenses.Scanner()
    rng = random.Random(8)
    parts = ["MIT", "License", "apache", "GNU", "General", "public", "license", "é", "2.0", "-", "\n", "mit"]
    for text in [*(" ".join(rng.choice(parts) for _ in range(12)) for _ in range(2000)), *(t for _, t in texts(documents))]:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower_ascii(text))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        n, k, first, last, base, labels, score = scanner.scan(text)
        assert (n, k) == (len(words), len(places)) and 0 <= score <= 1
        assert (first, last) == ((min(i for i, _ in places), max(i for i, _ in places)) if places else (None, None))
        assert base == ",".join(sorted({x for _, x in places})) and set(filter(None, base.split(","))) <= set(labels.split(","))


def test_matching_statistics():
    rng = random.Random(9)
    for _ in range(200):
        sequences = [[bytes([rng.choice(b"abc")]) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        automaton = licenses.SuffixAutomaton(sequences)
        words = [bytes([rng.choice(b"abcd")]) for _ in range(20)]
        inside = lambda w: any(s[i : i + len(w)] == w for s in sequences for i in range(len(s)))  # noqa: B023, E731
        longest = [max(n for n in range(e + 1) if n == 0 or inside(words[e - n : e])) for e in range(len(words) + 1)]
        wanted = [(e, longest[e]) for e in range(1, len(words) + 1) if longest[e] >= 1 and (e == len(words) or longest[e + 1] <= longest[e])]
        found = [(e, n) for e, n, _ in automaton.matches(words, 1)]
        assert found == wanted
        for e, n, state in automaton.matches(words, 1):
            assert all(sequences[k][at - n : at] == words[e - n : e] for k, at in automaton.ends[state].items())


def test_template_spans():
    scanner = licenses.Scanner()
    text = "Copyright 2020. " + licenses.TEMPLATES["bsd"][0].replace("forms", "forms,").title() + " Something else."
    assert scanner.scan(text)[5] == "bsd" and scanner.scan(text)[6] == 1.0
    for label, parts in licenses.TEMPLATES.items():
        for part in parts:
            assert label in scanner.scan(f"x {part.upper()} y")[5].split(",") and scanner.scan(part)[6] == 1.0
    # A passage that a template holds twice, a hole in the text, and a longer match of another template over a shorter one.
    twice = licenses.Scanner({"a": ("one two three four five one two three four six seven eight nine ten",), "b": ("zero one two three four six",)}, {})
    assert twice.spans(b"one two three four six seven eight nine ten".split()) == [("b", 0, 5, 5 / 6), ("a", 0, 9, 9 / 14)]
    assert ("a", 0, 14, 13 / 14) in twice.spans(b"one two three four five one two three four x six seven eight nine".split())
    assert scanner.scan("the software is free of the things and in the house")[5] == ""


# 8 ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.default_vocabulary())


def test_bpe_as_tiktoken(documents, codec):
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(10)
    made = ["".join(rng.choice("ab \nthe0é漢字😀ing\t's! \x1c") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    for text in [*made, *(t for _, t in texts(documents)), *(t or "" for _, t in ODD), "the" * 3000, "  a  b \n c"]:
        ids, said = codec.encode_both(text)
        assert ids == own.encode_ordinary(text) and said == " ".join(map(str, ids))
        assert codec.decode_bytes(ids) == text.encode() and "".join(codec.decode(ids, 3)) == text
        assert codec.digests(np.array(ids, int)) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    words = ["".join(rng.choice("etaoinéß漢 xq'9-") for _ in range(rng.randint(1, 90))).encode() for _ in range(3000)]
    ids, count = codec.lanes.encode(words)
    ends = np.cumsum(count).tolist()
    alone = [x for x in words if x not in codec.machine.ranks]
    assert [codec.machine.encode(x) for x in alone] == [ids[b - n : b].tolist() for x, b, n in zip(words, ends, count.tolist(), strict=True) if x not in codec.machine.ranks]
    assert [own._encode_single_piece(x) for x in alone] == [codec.machine.encode(x) for x in alone]


def test_bounded_tables():
    """Small bounds: words that leave the tables, states that are forgotten, texts cut into segments."""
    path, pattern = bpe.default_vocabulary()
    small = bpe.Codec(bpe.read_ranks(path), pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    small.pieces.half = 5_000
    rng = random.Random(22)
    saved = bpe.SEGMENT, bpe.LANE_STATES, bpe.LANE_PAIRS
    try:
        bpe.SEGMENT, bpe.LANE_STATES, bpe.LANE_PAIRS = 500, 300, 200
        for _ in range(30):
            made = ["".join(rng.choice("etaoin shrdlu  \n\té漢.,'s9") for _ in range(rng.randint(0, 1500))) for _ in range(8)]
            assert [x.tolist() for x in small.encode_texts(made)] == [own.encode_ordinary(t) for t in made]
    finally:
        bpe.SEGMENT, bpe.LANE_STATES, bpe.LANE_PAIRS = saved


def test_streams(codec):
    rng = random.Random(11)
    data = ("antidisestablishmentarianism" * 100).encode()
    cuts = sorted(rng.sample(range(len(data)), 40))
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
    assert list(codec.machine.encode_stream(parts)) == codec.machine.encode(data)
    machine = bpe.Utf8Machine()
    assert "".join(machine.feed(bytes([b])) for b in "é漢😀a".encode()) + machine.feed(b"", last=True) == "é漢😀a"


# 9 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert rows(found) == rows(connect(FOLDER).sql(queries.ORACLE_SQL[name]).df())


def test_budgets(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("web", "en", "b", 10), ("web", "de", "c", 1000), ("books", "en", "d", 1000)], "domain string, lang string, source string, supply long")
    got = {r.source: r.quota for r in mixing.quotas(leaves, 25, 1, {"web": 1, "books": 1}, {"en": 1, "de": 1}, {}).collect()}
    # 527 tokens: 263 a domain; English web can give 110 of its 131, German takes the rest before books do.
    assert got == {"a": 100, "b": 10, "c": 153, "d": 263} or (got["a"], got["b"], got["c"] + 110) == (100, 10, 263)


def test_mixing_odd(spark, empty):
    df = spark.createDataFrame([(None, "x" * 400, None, None, 0), (1, None, "en", "src0", 0), (2, "y" * 4000, "en", "src0", 0), (2, "y" * 4000, "en", "src0", 0), (3, "z" * 40, "de", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mix(df, percent=100, epochs=1).collect()
    assert sum(r._tokens * r._copies for r in found) <= 2110 and all(r._copies == 1 for r in found)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(df, percent=200, epochs=2).columns == df.columns
    clash = df.withColumns({n: F.lit("kept") for n in ("_tokens", "_copies", "_domain", "domain", "tokens", "copies", "row", "rest", "whole", "bound", "order", "id", "n", "_copy", "_lang", "_key")})
    names = mixing.added_names(clash)
    assert names == ("__domain", "__tokens", "__copies")
    got = mixing.mix(clash, percent=100, epochs=1).collect()
    assert sorted((r.doc_id or -1, r[names[1]], r[names[2]]) for r in got) == sorted((r.doc_id or -1, r._tokens, r._copies) for r in found) and all(r._tokens == r.order == "kept" for r in got)
    assert mixing.mixed_documents(clash, percent=100, epochs=1).columns == clash.columns


def test_mixing_by_brute_force(spark):
    """A hot source, ids that repeat, whole epochs and cuts; the search for the cut goes through several steps."""
    rng = random.Random(21)
    data = [(rng.randint(0, 40) if i % 3 == 0 else i, "x" * rng.randint(0, 400), rng.choice(["en", "de", None]), "src0" if rng.random() < 0.5 else f"src{rng.randint(1, 6)}") for i in range(6000)]
    data += data[:50] + [(7, "x" * 80, "en", "src0")] * 1500
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    for percent, epochs in ((60, 3), (150, 3)):
        found = Counter()
        for r in mixing.mix(df, percent=percent, epochs=epochs).collect():
            found[(r.doc_id, r.text, r.lang, r.source)] += r._copies
        facts = df.select(mixing.default_domain(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("(none)")).alias("lang"), "source", mixing.tokens_of(F.col("text")).alias("t"))
        plan = mixing.quotas(facts.groupBy("domain", "lang", "source").agg(F.sum("t").alias("supply")), percent, epochs, mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}).collect()
        wanted = Counter()
        for p in plan:
            whole, rest = divmod(p.quota, p.supply) if p.supply else (0, 0)
            rows = [d for d in data if (d[2] or "(none)", d[3]) == (p.lang, p.source)]
            # Rows equal in id and tokens are texts of one length here, and so equal; they are taken together.
            keyed = sorted((hashlib.sha256(f"{mixing.SEED}/{whole}/{d[0]}".encode()).hexdigest(), (len(d[1]) + 3) // 4) for d in rows)
            total, bound = 0, None
            for key, n in sorted(Counter(keyed).items()):
                total += key[1] * n
                if rest and total <= rest:
                    bound = key
            for d in rows:
                key = (hashlib.sha256(f"{mixing.SEED}/{whole}/{d[0]}".encode()).hexdigest(), (len(d[1]) + 3) // 4)
                wanted[d] += whole + (bound is not None and key <= bound)
        assert found == +wanted


# 10 --------------------------------------------------------------------------------------------------------------------


def plain_removed(documents, size=50):
    first, out = {}, []
    for i, data in sorted(((i, t.encode()) for i, t in documents), key=lambda x: x[0]):
        for at in range(len(data) - size + 1):
            first.setdefault(data[at : at + size], i)
    for i, t in documents:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - size + 1):
            if first[data[at : at + size]] < i:
                gone[at : at + size] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(spark):
    rng = random.Random(12)
    passage = "".join(rng.choice("abc de") for _ in range(200))
    made = []
    for i in range(60):
        noise = lambda: "".join(rng.choice("abcdefg éhi") for _ in range(rng.randint(0, 120)))
        a = rng.randint(0, 150)
        made.append((i, noise() + passage[a : a + rng.randint(20, 120)] + noise() + passage[: rng.randint(0, 60)]))
    made += [(100, "z" * 500), (101, "z" * 49), (102, "z" * 50), (103, "ab" * 400), (104, "ba" * 30), (105, made[3][1])]
    found = repeats.repeated_bytes(spark.createDataFrame(made, "doc_id long, text string"), block_bytes=2000, shards=5).collect()
    assert sorted(tuple(r) for r in found) == plain_removed(made)


def test_repeats_on_shared_table(documents):
    some = documents.where("doc_id < 120")
    found = repeats.repeated_bytes(some, block_bytes=100_000).collect()
    assert sorted(tuple(r) for r in found) == plain_removed(texts(some))


def test_suffix_array():
    rng = random.Random(13)
    for k in range(200):
        data = bytes(rng.choice(b"ab" if k % 3 else b"abcd\x00\xff") for _ in range(rng.randint(0, 90)))
        data = data[:15] * 5 if k % 5 == 0 else data
        text = np.frombuffer(data, np.uint8)
        order = sorted(range(len(data)), key=lambda i: data[i:])
        assert suffixes.suffix_array(text).tolist() == order


def test_names_are_sorted_recursively():
    """Strings of names: random, periodic, of few kinds and of many."""
    rng = random.Random(24)
    for k in range(500):
        names = [rng.randint(0, rng.choice([1, 2, 5, 60])) for _ in range(rng.randint(0, 60))]
        names = names[: max(1, len(names) // 5)] * 5 if k % 4 == 0 else names
        assert suffixes.sort_names(np.array(names, np.int64)).tolist() == sorted(range(len(names)), key=lambda i: names[i:])


# Pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, FOLDER)
        if at < 4:
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
    good, single, clean, mixed, encoded = seen
    labels = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {i for i, t in texts(spark.read.parquet(f"{FOLDER}/documents.parquet")) if quality.judge(t, labels)[6]}
    wanted = plain_components({i: plain_set(t) for i, t in texts(good)}, percent=80)
    assert {r.doc_id for r in single.collect()} == {i for i, c in wanted.items() if i == c}
    assert all(not plain_secrets(r.text.replace("[secret]", " ")) for r in clean.collect())
    assert Counter(r.doc_id for r in mixed.collect()).keys() <= {r.doc_id for r in clean.collect()}
    assert encoded.count() == mixed.count()


def test_pipeline_similarity(spark, documents):
    """Pairs of similarity 0.80 to 0.85 are near-duplicates in the stage, and are none in op4."""
    import corpus_pipeline

    rng = random.Random(14)
    made = []
    for k in range(30):
        base = [f"w{rng.randint(0, 99999)}" for _ in range(100)]
        copy = list(base)
        for at in (30, 60):
            copy[at] = f"n{rng.randint(0, 99999)}"
        made += [(10_000 + k, " ".join(base)), (20_000 + k, " ".join(copy))]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    sets = {i: plain_set(t) for i, t in texts(df)}
    wanted = plain_components(sets, percent=80)
    assert all(wanted[20_000 + k] == 10_000 + k for k in range(30))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, FOLDER).collect()} == {i for i, c in wanted.items() if i == c}
    own = {r.doc_id: r.component_id for r in queries.op4_minhash(spark, FOLDER).collect()}
    assert own == plain_components({i: plain_set(t) for i, t in texts(documents)}, percent=85)


def test_repeats_of_hot_names_and_long_texts(spark):
    """A short passage between different texts, documents in pieces, several groups, nulls and repeated ids."""
    rng = random.Random(17)
    noise = lambda n: "".join(rng.choice("abcdefghij klmé") for _ in range(n))
    common = noise(40)
    made = [(i, noise(rng.randint(60, 200)) + common + noise(rng.randint(60, 200))) for i in range(120)]
    made += [(200 + i, noise(700) + made[i][1] + noise(900) + made[i + 1][1] * 3) for i in range(10)]
    made += [(300, made[0][1]), (300, made[1][1]), (301, ""), (302, "a" * 5000), (303, "a" * 2600), (304, common * 60)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    found = repeats.repeated_bytes(df, block_bytes=1000, shards=7, group_bytes=3000, texts=True, hot=20).collect()
    assert sorted(tuple(r)[:5] for r in found) == plain_removed(made)
    packed = repeats.pack_blocks(df, "doc_id", "text", 50, 1000, 3000)
    marks = repeats._answer_names(repeats._send_names(packed, 50, 7, 4), 3, 20).collect()
    assert any(any(m.b) for m in marks) and not all(m.a == m.b for m in marks)  # some names are hot, not all
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found if "�" not in r.kept_text)
    odd = spark.createDataFrame([(None, "z" * 300), (1, "z" * 300), (2, None), (2, None), (0, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed) for r in repeats.repeated_bytes(odd, block_bytes=100).collect()) == [(False, 0, 0, 0), (False, 1, 300, 0), (False, 2, 0, 0), (False, 2, 0, 0), (True, None, 300, 0)]


def test_repeats_send_little_of_texts_of_few_words(spark):
    """Texts of the same words in another order share short strings, but no long ones: they don't go to the suffix arrays, however many there are."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    made = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(800)]
    made += [(1000 + i, made[i][1][100:400] + made[i + 20][1]) for i in range(10)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    packed = repeats.pack_blocks(df, "doc_id", "text", 50, 100_000, 200_000)
    marks = repeats._answer_names(repeats._send_names(packed, 50, 5, 32), 3, repeats.HOT)
    sent = sum(int(np.frombuffer(r.sizes, "<u4").sum()) for r in repeats._send_contents(packed, marks, 50, 5).collect())
    assert 0 < sent < 0.5 * sum(len(t) for _, t in made)
    found = repeats.repeated_bytes(df, block_bytes=100_000, group_bytes=200_000, shards=5).collect()
    assert sorted(tuple(r) for r in found) == plain_removed(made)


@pytest.mark.parametrize("size", [50, 20, 17, 16, 9, 5, 1])
def test_equal_windows_have_one_name(monkeypatch, size):
    """Wherever they are: in random and periodic texts, and over the border of what is named at once."""
    monkeypatch.setattr(repeats, "AT_ONCE", 150)
    rng = random.Random(size)
    some = bytes(rng.choice(b"abc ") for _ in range(300))
    texts = [some, b"x" * 11 + some, some[90:] + b"yz" + some[:120], b"a" * 400, b"b" + b"a" * 333, b"ab" * 150, b"abcab" * 70, some[:23] * 9, some[:40] * 7, b"q" * size, b""]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    starts, ends, grams = repeats._cut(data, sizes, [True] * len(texts), size)
    names, found, first = repeats._named(repeats._words_of(data, size), starts, grams, size), {}, np.concatenate(([0], np.cumsum(sizes)))
    for a, b, name in zip(starts.tolist(), ends.tolist(), names.tolist(), strict=True):
        for at in range(a, b):
            assert found.setdefault(data[at : at + size].tobytes(), name) == name
    windows = [at for a, b in zip(starts.tolist(), ends.tolist(), strict=True) for at in range(a, b)]
    assert windows == [at for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) for at in range(a, b - size + 1)]
    if size == 50:
        assert len(starts) < len(windows) / 4  # periodic texts are no single windows


def brute_digests(name, text):
    """The digest columns of the queries, from the plain versions."""
    if name == "op1_pii":
        spans = plain_pii(text)
        return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest(), [sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone")]
    spans = plain_secrets(text)
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest(), [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]


def test_digests_of_the_queries(spark, documents):
    """Every row of the queries without SQL against plain versions of their columns."""
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    given = dict(texts(documents))
    for name, counts in (("op1_pii", ["n_email", "n_ip", "n_card", "n_phone"]), ("op2_secrets", ["n_assign", "n_access", "n_hex"])):
        found = queries.QUERIES[name](spark, FOLDER).collect()
        assert len(found) == len(given)
        for r in found:
            assert (r.base_sha256, [r[c] for c in counts]) == brute_digests(name, given[r.doc_id])
            spans = [x for x in r.spans.split(",") if x]
            base = [x for x in spans if x.split(":")[0] in ("email", "ip", "card", "phone", "assign", "access", "hex")]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256 and r.n_spans == len(spans)
    for r in queries.QUERIES["op8_bpe"](spark, FOLDER).collect():
        ids = own.encode_ordinary(given[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(given[r.doc_id].encode()).hexdigest())
    for r in queries.QUERIES["op6_quality"](spark, FOLDER).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(given[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    for r in queries.QUERIES["op7_licenses"](spark, FOLDER).collect():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower_ascii(given[r.doc_id]))
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_odd_rows_have_results(spark, odd):
    """What null, empty, repeated and very long texts give in every column, not only that they give a row."""
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    given = [(i, t or "") for i, t in ODD]
    for name, digest in (("op1_pii", pii.pii_digest), ("op2_secrets", secrets.secrets_digest)):
        assert Counter((r.doc_id, r.base_sha256) for r in digest(odd).collect()) == Counter((i, brute_digests(name, t)[0]) for i, t in given)
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.encode_digest(odd).collect()) == Counter((i, len(own.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in given)
    assert Counter((r.doc_id, r.n_words, r.kept) for r in quality.quality(odd, quality.Field.prior()).collect()) == Counter((i, len(re.findall("[^\x20\x09-\x0d]+", t)), False) for i, t in given)
    assert Counter((r.doc_id, r.n_base, r.labels) for r in licenses.license_digest(odd).collect()) == Counter((i, 0, "") for i, _ in given)
    with_id = [(i, t) for i, t in given if i is not None]
    assert sorted(tuple(r) for r in repeats.repeated_bytes(odd.where("doc_id IS NOT NULL")).collect()) == plain_removed(with_id)
    assert secrets.redact(odd).columns == odd.columns and Counter((r.doc_id, r.text) for r in secrets.redact(odd, chars_col=None).collect()) == Counter(ODD)
    kept = quality.keep_good(odd, quality.Field.prior())
    assert kept.columns == odd.columns and kept.collect() == []


def test_one_row_of_each_id(spark):
    """Which of two texts under one id stays does not depend on the order of the rows."""
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "m n o p q r"), (None, "z"), (None, "z")]
    kept = [sorted((r.doc_id or 0, r.text) for r in minhash.keep_one(spark.createDataFrame(x, "doc_id long, text string")).collect()) for x in (rows, rows[::-1])]
    assert kept[0] == kept[1] and [i for i, _ in kept[0]] == [0, 0, 1, 2]


def test_large_groups_of_near_copies(spark):
    """More members than a block holds, most joined already, some not; and a group in two halves."""
    rng = random.Random(23)
    base = [f"w{rng.randint(0, 99999)}" for _ in range(90)]
    made = []
    for k in range(1500):
        copy = list(base)
        for at in rng.sample(range(90), 1 if k < 1100 else rng.randint(2, 4)):
            copy[at] = f"n{rng.randint(0, 999999)}"
        made.append((k, " ".join(copy)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    wanted = plain_components({i: plain_set(t) for i, t in made})
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == wanted
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == [] and minhash.keep_one(empty).collect() == []


def test_session_is_left_alone(spark):
    """Operators don't change the session's settings or the process's memory pool."""
    import pyarrow as pa

    before, pool = dict(spark.conf.getAll), pa.default_memory_pool().backend_name
    minhash.near_duplicates(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert dict(spark.conf.getAll) == before and pa.default_memory_pool().backend_name == pool


def test_pipeline_on_odd_tables(spark, tmp_path):
    """An empty table, null and empty texts, repeated rows and ids, null languages and sources."""
    import corpus_pipeline

    good = " ".join(f"word{i}" for i in range(80)) + "."
    for name, rows in (("empty", []), ("odd", [(None, good, "en", "s", 1), (1, None, "en", "s", None), (2, "", None, None, 0), (3, good, None, None, 1), (3, good, None, None, 1), (4, good + " token = 0123456789abcdef", "de", "src0", 1)])):
        folder = tmp_path / name
        rows += [(100 + i, good.replace("word", f"w{i}x"), "en", "s", 1) for i in range(30)] if rows else []
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in found} <= {None, 3, *range(100, 130)} and bool(found) == bool(rows)
