import random
import re

from tessera.llm.license_scan import PHRASES, TEMPLATES, scan_licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for label, phrase in PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scanned(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, template int")
    return scan_licenses(df).collect()


def test_base_matches_brute_force(spark):
    rng = random.Random(0)
    bag = ["MIT", "license", "License.", "Apache", "general", "public", "GNU", "the", "é", "İ", "mit-license", "x1"]
    rows = [(i, " ".join(rng.choices(bag, k=rng.randrange(0, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 40_000 + "MIT license"), (None, "the MIT License"), (5, "apache license twice"), (5, "apache license twice"), (1003, "license")]
    got = scanned(spark, rows)
    mine = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr)
    assert mine == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_templates_are_found_with_changes(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    words = mit.split()
    changed = " ".join(words[:9] + ["a", "strange"] + words[9:14] + words[15:])
    rows = [(1, "before " + mit), (2, changed), (3, "Licensed under CC BY-NC 4.0."), (4, "we got permission to use the software free of charge"), (5, " ".join(reversed(words)))]
    got = {r["doc_id"]: (r["labels"], r["n_base"], r["score"]) for r in scanned(spark, rows)}
    assert got[1][:2] == ("mit", 0) and got[2][:2] == ("mit", 0) and got[1][2] == 1.0 > got[2][2] >= 0.7
    assert got[3] == ("cc-by-nc", 0, 1.0) and got[4] == ("", 0, 0.0) and got[5][0] == ""


def brute_labels(text):
    """Labels and score by a plain dynamic programme over all common pairs of neighbouring words, for the templates alone."""
    words, found = re.findall("[a-z0-9]+", text.lower()), {}
    for label, template in TEMPLATES:
        t = template.split()
        hits = [(i, j) for i in range(len(words) - 1) for j in range(len(t) - 1, -1, -1) if words[i : i + 2] == t[j : j + 2] and j + 1 < len(t)]
        best = []
        for n, (i, j) in enumerate(hits):
            steps = [best[m] + min(2, j - b) for m, (a, b) in enumerate(hits[:n]) if a < i and b < j and abs(i - a - j + b) <= 3]
            best.append(max(steps, default=2))
        if best and max(best) >= 0.7 * len(t):
            found[label] = max(found.get(label, 0), max(best) / len(t))
    return set(found), max(found.values(), default=0.0)


def test_labels_match_brute_force(spark):
    rng, rows = random.Random(4), []
    for n in range(250):
        words = []
        for _ in range(rng.randrange(1, 4)):
            piece = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 7)):
                at = rng.randrange(len(piece))
                if rng.random() < 0.4:
                    del piece[at]
                elif rng.random() < 0.6:
                    piece.insert(at, rng.choice(["odd", "the", "license", *piece]))
                else:
                    a, b, c = sorted(rng.randrange(len(piece) + 1) for _ in range(3))
                    piece = piece[:a] + piece[b:c] + piece[a:b] + piece[c:]
                if len(piece) < 3:
                    break
            words += piece + [rng.choice(["x", "the", "and"])] * rng.randrange(0, 9)
        rows.append((n, " ".join(words)))
    rows.append((999, "in source and redistribution and use binary forms with or without modification that the following are permitted provided conditions are met"))
    got = {r["doc_id"]: r for r in scanned(spark, rows)}
    seen = set()
    for n, text in rows:
        labels, score = brute_labels(text)
        base = {label for label, phrase in PHRASES if f" {phrase} " in f" {text} "}
        assert set(got[n]["labels"].split(",")) - {""} == labels | base, text
        assert abs(got[n]["score"] - (1.0 if base else score)) < 1e-9
        seen.add(bool(labels))
    assert seen == {True, False} and got[999]["score"] < 0.75


def test_repeated_templates_in_one_text(spark):
    text = " ".join(TEMPLATES[7][1] for _ in range(2_000)) + " the following conditions" * 20_000
    got = scanned(spark, [(1, text)])[0]
    assert (got["labels"], got["score"]) == ("bsd", 1.0)


def test_empty_table(spark):
    assert scanned(spark, []) == []
