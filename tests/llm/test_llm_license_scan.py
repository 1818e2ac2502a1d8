import random
import re

import cases
import hypothesis.strategies as st
import pytest
from hypothesis import given, settings

from orderlens.llm import license_scan as ls
from orderlens.llm.license_scan import TEMPLATES, THRESHOLD


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text):
    w = words(text)
    return set(zip(w, w[1:]))


EVERY = ls.every_template(TEMPLATES)


def dice(window, template):
    own, other = bigrams(" ".join(window)), bigrams(template)
    return 2 * len(own & other) / (len(own) + len(other)) if own else 0.0


def best_window(text, template):
    """The highest coefficient of all windows of a template's length."""
    w, length = words(text), len(words(template))
    return max(dice(w[i : i + length], template) for i in range(max(1, len(w) - length + 1)))


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {i: [] for i in range(len(texts))}
    for r in ls.license_spans(df).collect():
        found[r.doc_id].append((r.license, r.dice, r.span, r.start))
    return found


def test_every_template_is_found_in_prose_wrapped_at_each_word(spark):
    """No sentence or paragraph begins or ends at the notice; nothing else is named."""
    texts, expected = [], []
    for name, template in EVERY:
        parts = template.split()
        for at in range(1, len(parts), 1 if len(parts) < 40 else 7):
            notice = " ".join(parts[:at]) + "\n" + " ".join(parts[at:])
            texts.append(f"{cases.PROSE} and so {notice.rstrip('.')} and then {cases.PROSE}")
            expected.append((name, 1.0, " ".join(words(template)), len(words(cases.PROSE)) + 2))
    found = scanned(spark, texts)
    assert len(texts) > 400
    assert {i: f for i, f in found.items() if f != [expected[i]]} == {}


def test_edited_notices_keep_their_license(spark):
    """A notice of which some words are replaced, left out or added is found if some window of its length is alike."""
    r = random.Random(5)
    texts, expected, alike = [], [], []
    for name, template in EVERY:
        for _ in range(6):
            parts = words(template)
            for _ in range(len(parts) // 12):
                at = r.randrange(len(parts))
                if not parts[at].isdigit():
                    parts[at : at + 1] = r.choice(([], ["edited"], [parts[at], "edited"]))
            texts.append(f"{cases.PROSE} and so {' '.join(parts)} and then {cases.PROSE}")
            expected.append(name)
            alike.append(best_window(texts[-1], template))
    found = scanned(spark, texts)
    sure = [i for i in range(len(texts)) if alike[i] >= 0.88]
    assert len(sure) > 120
    # An edit can take away the word that tells two licenses apart; then the other must be as much alike.
    for i in sure:
        names = {f[0] for f in found[i]}
        assert names == {expected[i]} or len(names) == 1 and max(
            best_window(texts[i], t) for name, t in EVERY if name in names
        ) >= alike[i], (texts[i], found[i])


def test_versions_and_families_are_told_apart(spark):
    """Whole notices of one license never name another."""
    for name, template in EVERY:
        for other, text in EVERY:
            if name != other and set(ls.template_numbers(text)) - set(words(template)):
                assert best_window(template, text) < 1
    found = scanned(spark, [t for _, t in EVERY] + [t.replace("version 3", "version 7") for _, t in EVERY])
    assert [{f[0] for f in found[i]} for i in range(len(EVERY))] == [{name} for name, _ in EVERY]
    for i, (_, template) in enumerate(EVERY):
        if "version 3" in template:
            assert found[len(EVERY) + i] == []


def test_notices_one_after_the_other(spark):
    notices = ["Released under the MIT License.", "Licensed under CC BY 4.0.", TEMPLATES["ISC"][0], TEMPLATES["MIT"][2]]
    found = scanned(spark, [" ".join(notices), "\n\n".join(notices), notices[0] * 3, (notices[0] + " ") * 200])
    for i in (0, 1):
        assert [f[0] for f in sorted(found[i], key=lambda f: f[3])] == ["MIT", "CC-BY-4.0", "ISC", "MIT"]
    assert len(found[3]) == 200 and sorted(f[3] for f in found[3]) == list(range(0, 1000, 5))


def test_sentences_and_paragraphs_of_other_lengths(spark):
    """Notices that lack their last words are found as a sentence or paragraph within the size bounds."""
    texts, expected = [], []
    for name, template in EVERY:
        shorter = " ".join(template.split()[: int(len(template.split()) * 0.9)]).rstrip(".")
        if dice(words(shorter), template) >= THRESHOLD and set(ls.template_numbers(template)) <= set(words(shorter)):
            texts.append(f"{cases.PROSE}.\n \n{shorter}\n\n{cases.PROSE}")
            expected.append(name)
    found = scanned(spark, texts)
    # What is left of the longest is at least the shorter notice of the same family.
    near = {"0BSD": "ISC", "ISC": "0BSD"}
    wrong = {i: found[i] for i in found if {f[0] for f in found[i]} not in ({expected[i]}, {near.get(expected[i])})}
    assert len(texts) > 15 and wrong == {}


@settings(max_examples=300, deadline=None)
@given(data=st.data(), threshold=st.sampled_from([0.3, 0.5, 0.8, 0.95]))
def test_every_match_holds_an_anchor_and_is_within_the_bounds(data, threshold):
    template = data.draw(st.sampled_from([t for texts in TEMPLATES.values() for t in texts]))
    kept = data.draw(st.lists(st.sampled_from(words(template)), max_size=40))
    start = data.draw(st.integers(0, len(words(template))))
    span = " ".join(words(template)[start:] + kept)
    own, other = bigrams(span), bigrams(template)
    if own and 2 * len(own & other) / (len(own) + len(other)) >= threshold:
        assert set(words(span)) & ls.anchors(template, threshold)
        assert ls.least_size(len(other), threshold) <= len(own) <= ls.most_size(len(other), threshold)


def test_edge_cases(spark):
    df = cases.edge_table(spark)
    rows = ls.licenses(ls.license_spans(df)).collect()
    assert [tuple(r) for r in rows] == [(11, "MIT", 1, 1.0)]
    assert ls.license_spans(cases.empty_table(spark)).count() == 0
    with pytest.raises(ValueError):
        ls.license_spans(df, threshold=0)


def test_no_python_and_no_shuffle(spark, capsys):
    ls.license_spans(cases.edge_table(spark, extra=False)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan
