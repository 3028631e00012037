import random

import numpy as np
import pytest

from millrace.llm import licenses

from .conftest import ODD


def full_alignment(t, w):
    """Score of the best local alignment without a band, by plain dynamic programming."""
    best, above = 0, [0] * (len(w) + 1)
    for a in t:
        row = [0]
        for j, b in enumerate(w):
            row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_banded_alignment(words):
    rng = random.Random(3)
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        w = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            rng.choice([lambda i=i: w.insert(i, "new"), lambda i=i: len(w) > 1 and w.pop(i), lambda i=i: w.__setitem__(i, "other")])()
        a, b = licenses._hashes(t), licenses._hashes(["x"] * 6 + w + ["y"] * 6)
        equal, first, last, x, y = licenses.align(a, b, 6)
        assert t[first] == (["x"] * 6 + w)[x] and equal <= last - first + 1
        # what the band finds is what the whole table finds
        gaps = (last - first + 1 - equal) + (y - x + 1 - equal)
        assert 2 * equal - gaps <= full_alignment(a.tolist(), b.tolist()) <= 2 * equal


def test_whole_templates_are_found():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for before, after in (("", ""), ("some words before it\n", "\nand after"), ("x " * 300, " y" * 5)):
            found = index.matches(before + text + after, 0.8)
            assert (name, 1.0) in [m[:2] for m in found], name
            m = next(m for m in found if m[0] == name)
            got, want = (before + text + after)[m[3] : m[4]], text.rstrip('."')
            assert want.startswith(got[:20]) and want[-12:] in got[-14:] + want[-12:] and abs(len(got) - len(want)) <= 2


def test_changed_and_partial_templates(words):
    rng = random.Random(4)
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["mit"].split(" ")
    near = [rng.choice(words) if i % 15 == 7 else x for i, x in enumerate(mit)]
    (m,) = index.matches(" ".join(near), 0.8)
    assert m[0] == "mit" and 0.85 < m[1] < 1
    assert index.matches(" ".join(mit[: len(mit) // 2]), 0.8) == [] and index.matches(" ".join(mit[: len(mit) // 2]), 0.4)[0][0] == "mit"
    assert index.matches(" ".join(rng.choice(words) for _ in range(500)), 0.8) == []
    twice = index.matches("Released under the MIT License.\n" * 2, 0.8)
    assert [m[0] for m in twice] == ["mit-line", "mit-line"] and twice[0][4] <= twice[1][3]


def test_scan(spark, none):
    texts = [*ODD, licenses.TEMPLATES["isc"], "released UNDER the\nmit license", None]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, licenses.TEMPLATES["isc"], "x", 1)] * 2, "doc_id long, text string, license string, start int")
    got = sorted((str(r["doc_id"]), r["license"], r["coverage"]) for r in licenses.scan(df).collect())
    assert got == [(str(len(ODD)), "isc", 1.0), (str(len(ODD) + 1), "mit-line", 1.0), ("None", "isc", 1.0), ("None", "isc", 1.0)]
    assert licenses.scan(none).count() == 0 and licenses.scan(df, {"empty": "..."}).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, {"big": "x" * (licenses.TEMPLATE_BYTES + 1)})
    assert np.array_equal(licenses.fingerprints(licenses._hashes([]))[0], [])


def test_templates_end_where_the_licences_do():
    ends = {"mit": "OTHER DEALINGS IN THE SOFTWARE.", "isc": "PERFORMANCE OF THIS SOFTWARE.", "bsd-3-clause": "THE POSSIBILITY OF SUCH DAMAGE.", "gpl-3.0-notice": "see <https://www.gnu.org/licenses/>."}
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for name, end in ends.items():
        text = licenses.TEMPLATES[name]
        assert text.endswith(end)
        words = text.split(" ")
        assert name not in [m[0] for m in index.matches(" ".join(words[: len(words) * 6 // 10]), 0.8)]


def test_short_templates_with_changed_words(words):
    """Every short template is found at the coverage, whichever words differ or come between."""
    rng = random.Random(6)
    found = licenses.TemplateIndex(licenses.TEMPLATES).matches("Released under an MIT License", 0.8)
    assert [m[:2] for m in found] == [("mit-line", 0.8)]
    for name, text in licenses.TEMPLATES.items():
        own = licenses.word_spans(text)[0]
        if len(own) >= licenses.SHORT:
            continue
        index = licenses.TemplateIndex({name: text})
        for _ in range(100):
            changed = list(own)
            for i in rng.sample(range(len(own)), len(own) // 5):
                changed[i] = "zzz"
            near = ["yy"] * 6 + changed + ["yy"] * 6
            t, w = licenses._hashes(own), licenses._hashes(near)
            equal = max(licenses.align(t, np.concatenate([np.zeros(max(0, 4 - d), np.uint64), w[max(0, d - 4) :]])[: len(own) + 8], 4)[0] for d in range(len(near)))
            assert bool(index.matches(" ".join(near), 0.8)) == (equal >= 0.8 * len(own)), near


@pytest.mark.parametrize("name", ["mit", "bsd-3-clause", "gpl-3.0-notice", "apache-2.0-notice", "isc"])
def test_runs_left_out_put_in_and_moved(words, name):
    """A template is found whenever enough of it is left, wherever one run is left out; and when a run is put in."""
    rng = random.Random(name)
    own = licenses.word_spans(licenses.TEMPLATES[name])[0]
    index, n = licenses.TemplateIndex({name: licenses.TEMPLATES[name]}), len(own)
    noise = lambda k: [rng.choice(words) for _ in range(k)]
    for k in (1, n // 12, n // 8, n // 5):
        for _ in range(12):
            i = rng.randrange(n - k + 1)
            text = " ".join([*noise(40), *own[:i], *own[i + k :], *noise(40)])
            (m,) = index.matches(text, 0.8)
            assert m[0] == name and m[2] >= n - k
            i = rng.randrange(n // 4, 3 * n // 4)
            (m,) = index.matches(" ".join([*noise(40), *own[:i], *noise(2 * k), *own[i:], *noise(40)]), 0.8)
            assert m[2] == n
    for _ in range(12):  # two runs left out, and one moved to the end
        i, k = rng.randrange(n // 2), n // 10
        j = rng.randrange(n // 2, n - k)
        (m,) = index.matches(" ".join([*noise(9), *own[:i], *own[i + k : j], *own[j + k :], *noise(9)]), 0.8)
        assert m[2] >= n - 2 * k
        (m,) = index.matches(" ".join([*own[:i], *own[i + k :], *own[i : i + k]]), 0.8)
        assert m[2] >= n - k


def test_every_occurrence_is_found(words):
    """Copies side by side, damaged each in another way, with and without text between."""
    rng = random.Random(8)
    own = licenses.word_spans(licenses.TEMPLATES["gpl-3.0-notice"])[0]
    index, n = licenses.TemplateIndex(licenses.TEMPLATES), len(licenses.word_spans(licenses.TEMPLATES["gpl-3.0-notice"])[0])
    for between in (0, 1, 30, 300):
        text: list[str] = []
        for k in range(7):
            i = rng.randrange(n - n // 6)
            text += [*([rng.choice(words) for _ in range(between)]), *own[:i], *own[i + k * n // 40 :]]
        found = index.matches(" ".join(text), 0.8)
        assert [m[0] for m in found] == ["gpl-3.0-notice"] * 7
        assert all(a[4] <= b[3] for a, b in zip(found, found[1:], strict=False))


def test_whole_scans_equal_alignments_without_a_band(words):
    """What the index and the band find is what the full table of every template finds."""
    rng = random.Random(9)
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for _ in range(40):
        name = rng.choice([n for n in sorted(licenses.TEMPLATES) if len(licenses.word_spans(licenses.TEMPLATES[n])[0]) >= licenses.SHORT])
        text = licenses.word_spans(licenses.TEMPLATES[name])[0]
        for _ in range(rng.randint(0, 6)):
            i, k = rng.randrange(len(text)), rng.randrange(12)
            text = rng.choice([text[:i] + text[i + k :], text[:i] + [rng.choice(words) for _ in range(k)] + text[i:]]) or ["x"]
        text = [rng.choice(words) for _ in range(20)] + text + [rng.choice(words) for _ in range(20)]
        h, t = licenses._hashes(text), index.names.index(name)
        n = len(index.words[t])
        wide = len(h) + n
        equal = licenses.align(index.words[t], np.concatenate([np.zeros(wide, np.uint64), h]), wide)[0]
        got = [m[2] for m in index.matches(" ".join(text), 0.8) if m[0] == name]
        assert (max(got, default=0) >= equal) if equal >= 0.8 * n else not got or max(got) >= 0.8 * n
