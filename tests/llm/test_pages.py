"""Page differencing on unmarked pages against a plain version, for any number of parts."""

import random
import re

import pytest

from assayer.llm import html_text
from tests.llm import brute

SCHEMA = "page_id bigint, url string, html string, host string, path string, key binary, part int, shared array<int>"


def _pages():
    rng = random.Random(4)
    story = [f"Sentence {i} of the stock" for i in range(40)]
    rows = []
    for host, n in (("hot.example", 90), ("b.example", 9), ("c.example", 1)):
        for i in range(n):
            top, end = ["Welcome", f"Section {i // 20}", "Read more"], ["About us", f"Printed by {host}"]
            own = rng.sample(story, rng.randrange(6))
            rows.append((len(rows), f"https://{host}/{i // 10}/{i:03}", "".join(f"<p>{x}</p>" for x in top + own + end)))
    same = "<p>Welcome</p><p>The same page</p><p>About us</p>"
    rows += [(1000 + i, f"https://hot.example/3/copy{i:02}", same) for i in range(12)]  # a run of copies
    rows += [(2000, None, None), (2001, "no url", "<p>x</p>"), (2002, None, "<div><p>x</p><p>y</p></div>"), (7, rows[7][1], rows[7][2]), (None, "https://b.example/z", "<p>Welcome</p><p>z</p>")]
    rows.append((3000, "https://long.example/a", "".join(f"<p>line {i}</p>" for i in range(30_000))))
    rows.append((3001, "https://long.example/b", "".join(f"<p>line {i}</p>" for i in range(0, 60_000, 3))))
    return rows


def _plain(rows):
    """Neighbours among pages with different lines, and the longest common subsequence by the operator's own alignment."""
    keyed = []
    for i, url, html in rows:
        m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
        keyed.append((m[1].lower() if m else "", m[2] if m else "", i, html_text.lines(html or "")))
    least = {}
    for host, path, i, own in keyed:
        at = (path, i is not None, i or 0)
        key = (host, tuple(own))
        least[key] = min(least.get(key, at), at)
    order = sorted((h, *at, own) for (h, own), at in least.items())
    out = []
    for host, _, i, own in keyed:
        k = next(j for j, x in enumerate(order) if x[0] == host and x[4] == tuple(own))
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == host]
        other = max(near, key=lambda x: html_text._alike(x[1], order[k][1]), default=None)
        out.append((i, html_text.main_text(own, other and list(other[4]))))
    return out


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_text_does_not_depend_on_the_parts(spark, parts):
    rows = _pages()
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        pages = spark.createDataFrame([(*r, "x", "y", b"k", 1, [0]) for r in rows], SCHEMA).repartition(min(parts, 20))
        got = [(r.page_id, r.text) for r in html_text.extracted(pages).collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    by = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=by) == sorted(_plain(rows), key=by)
    texts = dict(got)
    assert all("Welcome" not in texts[i] and "About us" not in texts[i] for i in range(99)) and texts[99].startswith("Welcome")
    assert all(texts[1000 + i] == "The same page" for i in range(12)) and texts[2000] == ""


def test_alignment_of_random_pages_is_longest():
    rng = random.Random(9)
    for _ in range(30):
        a, b = ([(rng.choice("abcd"), html_text.LOOSE) for _ in range(rng.randrange(1, 10))] for _ in range(2))
        text = html_text.main_text(a, b)
        assert len(a) - (len(text.split("\n")) if text else 0) == brute.lcs(a, b)
