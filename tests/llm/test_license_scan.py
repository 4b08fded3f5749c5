import random

from sourcequarry.llm.license_scan import PHRASES, TEMPLATES, LicenseAutomaton, scan_licenses, words_of


def longest_runs(words, templates):
    """Matching statistics by brute force."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max(n for n in range(i + 2) if n == 0 or tuple(words[i + 1 - n:i + 1]) in runs) for i in range(len(words))]


def test_automaton_knows_every_run():
    r = random.Random(3)
    for _ in range(30):
        texts = [[r.choice("abc") for _ in range(r.randrange(1, 9))] for _ in range(3)]
        automaton = LicenseAutomaton({str(i): [" ".join(t)] for i, t in enumerate(texts)}, {})
        words = [r.choice("abcd").encode() for _ in range(60)]
        state = length = 0
        lengths = []
        for word in words:
            w = automaton.vocabulary.get(word)
            while state > 0 and w not in automaton.next[state]:
                state = automaton.link[state]
                length = automaton.length[state]
            if w in automaton.next[state]:
                state, length = automaton.next[state][w], length + 1
            else:
                state = length = 0
            lengths.append(length)
            at = [(t, e) for t, text in enumerate(texts) for e in range(len(text)) if length and e + 1 >= length and
                  [x.encode() for x in text[e + 1 - length:e + 1]] == words[len(lengths) - length:len(lengths)]]
            assert not length or sorted(automaton.places[state]) == at
        assert lengths == longest_runs(words, [[x.encode() for x in t] for t in texts])


def test_whole_and_damaged_licences():
    automaton = LicenseAutomaton(TEMPLATES, PHRASES)
    mit = TEMPLATES["mit"][0]
    spans = automaton.scan(words_of("Some code. " + mit + " More."))
    whole = [s for s in spans if s.label == "mit" and s.cover == 1.0]
    assert whole and whole[0].first == 2 and whole[0].end == 2 + len(words_of(mit))
    words = words_of(mit)
    damaged = words[:40] + [b"inserted", b"words"] + words[40:80] + words[84:]
    best = max(s.cover for s in automaton.scan(damaged) if s.label == "mit")
    assert 0.9 < best < 1
    assert not automaton.scan(words[:30])  # under half of the template
    assert [s.label for s in automaton.scan(words_of("MIT License, Apache-License general public\nLICENSE"))] == ["mit", "apache", "gpl"]


def test_matches_are_complete_for_each_template():
    """Against brute force: every run that a template has and that goes on at neither end."""
    r = random.Random(6)
    for _ in range(200):
        texts = [[r.choice("abcde") for _ in range(r.randrange(2, 14))] for _ in range(3)]
        texts.append(texts[0][:r.randrange(1, len(texts[0]) + 1)])
        automaton = LicenseAutomaton({str(i): [" ".join(t)] for i, t in enumerate(texts)}, {})
        words = [r.choice("abcdef") for _ in range(10)] + texts[0] + [r.choice("abcdef") for _ in range(5)] + texts[1] + texts[3]
        found = {}
        automaton._chains = lambda t, some: found.setdefault(t, sorted(some)) and []  # noqa: B023
        automaton.scan([w.encode() for w in words])
        for t, text in enumerate(texts):
            want = []
            for i in range(len(words)):
                for j in range(len(text)):
                    n = 0
                    while i + n < len(words) and j + n < len(text) and words[i + n] == text[j + n]:
                        n += 1
                    begins = i == 0 or j == 0 or words[i - 1] != text[j - 1]
                    if begins and n >= max(min(5, len(text)), automaton.shortest):
                        want.append((i, j, n))
            assert found.get(t, []) == sorted(want)


def test_templates_within_longer_matches():
    automaton = LicenseAutomaton(TEMPLATES, PHRASES)
    spans = automaton.scan(words_of('Licensed under the Apache License, Version 2.0 (the "License"); you may'))
    assert [(s.first, s.end, s.cover) for s in spans if not s.phrase] == [(0, 8, 1.0)]
    nested = LicenseAutomaton({"short": ["a b c d e f"], "long": ["a b c d e f g h i j k l m n o p q r s t u v w x y z"]}, {})
    assert [(s.label, s.first, s.end, s.cover) for s in nested.scan(words_of("a b c d e f g h"))] == [("short", 0, 6, 1.0)]
    repeated = LicenseAutomaton({"x": ["a b c d e f g h a b c d e i j k"]}, {})
    assert [(s.first, s.end, s.cover) for s in repeated.scan(words_of("y a b c d e f g h a b c d e i j k"))] == [(1, 17, 1.0)]


def test_nulls_long_texts_and_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, None, 7, "a"), (1, "", 7, "a"), (2, "mit license " * 50_000, 7, None), (2, "mit license " * 50_000, 7, None), (None, "é!mit-License", None, None)],
        "doc_id int, text string, n_words int, label string")
    rows = scan_licenses(docs).collect()
    assert sorted((r["n_words"], len(r["license_spans"])) for r in rows) == [(0, 0), (0, 0), (3, 1), (100_000, 50_000), (100_000, 50_000)]
    assert set(rows[0].asDict()) == {"doc_id", "label", "n_words", "license_spans"}
    assert scan_licenses(docs.limit(0)).count() == 0
