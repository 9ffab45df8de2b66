import re
from collections import Counter

import pyarrow as pa

from lodestone.llm import rules
from lodestone.llm.blocks import slices


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered |= set(range(i, i + 5))
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            again += line in seen
        seen.add(line)
    n, chars = len(words), sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    base_failed = n < 10 or 100 * len(covered) > 20 * n
    upper = len(re.findall("[A-Z]", text))
    letters = sum(c.isascii() and c.isalpha() or ord(c) > 127 for c in text)
    other = 100 * symbols > 10 * n or chars < 2 * n or chars > 20 * n or 100 * again > 30 * max(lines, 1) or 100 * upper > 60 * max(letters, 1)
    return n, chars, symbols, again, len(covered), base_failed, not base_failed and not other


def test_counts_and_verdicts(tricky, no_docs):
    texts = {r.doc_id: r.text for r in tricky.collect()}
    rows = rules.apply_rules(tricky).collect()
    assert len(rows) == tricky.count()
    for r in rows:
        assert tuple(r[1:]) == brute(texts[r.doc_id]), texts[r.doc_id]
    alone = {(r.doc_id, r.kept) for r in rules.apply_rules(tricky, with_counts=False).collect()}
    assert alone == {(r.doc_id, r.kept) for r in rows}
    assert rules.apply_rules(no_docs).count() == 0


def test_any_order_gives_the_same_verdicts(tricky):
    texts = [r.text for r in tricky.collect()]
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        want = rules.cascade(rules.Stats(part), rules.RULES).tolist()
        assert want == rules.cascade(rules.Stats(part), rules.RULES[::-1]).tolist()
        assert want == [brute(t)[-1] for t in texts]


def test_rejected_rows_are_not_evaluated():
    seen = []

    def watch(stats):
        seen.extend(stats.part.raw(r).decode() for r in range(stats.part.n))
        return stats.n_repeat_words < 0

    texts = ["few", "a b c d e f g h i j k l", None, "x y", "one two three four five six seven eight nine ten"]
    (part,) = slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]))
    kept = rules.cascade(rules.Stats(part), (rules.BASE[0], rules.Rule("watch", watch)))
    assert seen == [texts[1], texts[4]] and kept.tolist() == [False, True, False, False, True]


def test_the_order_is_conditional_and_the_same_each_time():
    # the second rule rejects what the first has rejected already, so the third comes before it
    texts = ["# A"] * 40 + ["word"] * 20 + ["ab"] * 40
    tried = (rules.Rule("symbols", lambda s: s.n_symbols > 0), rules.Rule("capitals", lambda s: s.n_upper > 0), rules.Rule("letters", lambda s: s.n_letters > 3))
    assert rules.order_rules(texts, tried) == rules.order_rules(texts, tried) == [0, 2, 1]
    assert rules.order_rules([], tried) == [0, 1, 2]


def test_the_sample_is_of_whole_texts_by_hash(spark):
    rows = [(i, "x" * (40_000 if i % 7 == 0 else i + 1)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rules.sample_texts(docs, 300)
    assert 200 < len(got) <= 300 and set(got) <= {t for _, t in rows} and max(map(len, got)) > 1000


def test_cheap_selective_rules_come_first():
    texts = ["few"] * 50 + ["a b c d e f g h i j k l m n o p"] * 50
    order = rules.order_rules(texts, rules.RULES)
    assert order[0] == 0
