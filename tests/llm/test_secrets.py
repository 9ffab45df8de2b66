import hashlib
import random
import re
import string
import time

import pytest

from lodestone.llm import secrets

ORDER = ["assign", "access", "hex", "random"]


def base(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda x: (x[1], ORDER.index(x[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_match_brute_force(tricky):
    rows = tricky.select("doc_id", "text").collect()
    got = secrets.scan_secrets(tricky).collect()
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in rows}
    assert sum(r.n_assign for r in got) >= 2 and sum(r.n_access for r in got) == 1
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        kept = [x for x in r.spans.split(",") if x and not x.startswith("random")]
        assert ",".join(kept) == joined(want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == name for k, _, _ in want) for name in ORDER[:3])


def test_random_strings_found_and_identifiers_left(tricky):
    row = next(r for r in secrets.scan_secrets(tricky).collect() if r.n_random)
    text = next(r.text for r in tricky.collect() if r.doc_id == row.doc_id)
    found = [x.split(":") for x in row.spans.split(",") if x.startswith("random")]
    assert [text[int(a) : int(b)] for _, a, b in found] == ["q8Zk2LmX9vB4tR7wY1cN6pJ3sD5f"]


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_uppercase, string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits])
@pytest.mark.parametrize("length", [20, 32])
def test_random_strings_of_few_letters_are_found(letters, length):
    rnd, encoding = random.Random(length), secrets._encoding(secrets.vocabulary_path())
    runs = ["".join(rnd.choice(letters) for _ in range(length)) for _ in range(500)]
    assert sum(secrets.is_random(run, encoding) for run in runs) >= 0.95 * len(runs)


@pytest.mark.parametrize("name", ["some_long_snake_case_name", "internationalization_settings", "src/components/navigation/header", "MAXIMUM_CONNECTION_ATTEMPTS", "getElementsByClassName", "state-of-the-art-methods", "2026-11-26/2026-12-31"])
def test_names_made_of_words_are_left(name):
    assert not secrets.is_random(name, secrets._encoding(secrets.vocabulary_path()))


def test_random_spans_match_a_plain_version():
    rnd, encoding = random.Random(3), secrets._encoding(secrets.vocabulary_path())
    draw = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits + "+/_=-") for _ in range(n))
    parts = ["password=" + draw(30), "token: abc", "AKIA" + "Q7" * 12, "0123456789abcdef" * 2, "some_long_snake_case_name", "é"]
    for _ in range(40):
        text = "".join(rnd.choice([*parts, draw(rnd.randint(5, 40))]) + rnd.choice([" ", "\n", ".", ""]) for _ in range(12))
        spans = base(text)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
            if len(m[0]) >= secrets.MIN_RUN and not any(a < m.end() and m.start() < b for _, a, b in spans[: len(base(text))]) and secrets.is_random(m[0], encoding):
                spans.append(("random", m.start(), m.end()))
        batch = secrets.pa.RecordBatch.from_arrays([secrets.pa.array([text])], ["text"])
        (part,) = secrets.slices(batch)
        (got,) = secrets.scan_slice(part, encoding, secrets.MIN_RUN, secrets.MAX_CHARS_PER_TOKEN)
        assert [(ORDER[k], a, b) for a, b, k in got] == sorted(spans, key=lambda x: (x[1], ORDER.index(x[0])))


def test_a_long_list_of_digests_takes_linear_time():
    encoding, line = secrets._encoding(secrets.vocabulary_path()), "0123456789abcdef" * 4 + "\n"
    (part,) = secrets.slices(secrets.pa.RecordBatch.from_arrays([secrets.pa.array([line * 60_000])], ["text"]))
    began = time.perf_counter()
    (spans,) = secrets.scan_slice(part, encoding, secrets.MIN_RUN, secrets.MAX_CHARS_PER_TOKEN)
    assert len(spans) == 60_000 and time.perf_counter() - began < 20


def test_redaction_keeps_rows_and_columns(tricky):
    out = secrets.redact_secrets(tricky)
    assert out.columns == tricky.columns and out.count() == tricky.count()
    for r in secrets.scan_secrets(out).collect():
        assert not r.spans


def test_empty_table(no_docs):
    assert secrets.scan_secrets(no_docs).count() == 0
