from mentionlake.sources import archive as R

HOST = "vejario.abril.com.br"


def page(k, n, *days):
    cards = "".join(f'<div id="post-{d}" class="list-item"><a href="/{k}/a-story-of-the-day-{d}">Story {d}</a><time>{d} janeiro 2024</time></div>' for d in days)
    script = '<script>var infiniteScroll = {"settings":{"id":"content","path":"\\/%s\\/pagina\\/%%d\\/"}};</script>' % k
    return f"https://{HOST}/{k}/" + (f"pagina/{n}/" if n > 1 else ""), cards + script


def test_items_are_read_of_pages_that_links_lead_to_a_row_a_card(spark, monkeypatch):
    """Before, the items of every capture were read, all of a page in one row."""
    tables, kept = [], R.settled
    monkeypatch.setattr(R, "settled", lambda df: tables.append(kept(df)) or tables[-1])
    captures = spark.createDataFrame([page("view", 1, 31, 30), page("view", 2, 29, 3), page("view", 3, 2, 1), page("view", 4, 28), page("other", 1, 31)], "url string, html string")
    found = R.archive(captures, [("v", f"https://{HOST}/view/")], "magazine", HOST, name="A", date_from="2024-01-21", most_pages=4)
    assert sorted((r.page, r.pos, r.title) for r in found.collect()) == [(1, 0, "Story 31"), (1, 1, "Story 30"), (2, 0, "Story 29")]  # the third page is old and ends the way
    read = [t for t in tables if t.columns == ["page", "i"]]
    assert len(read) == 1 and read[0].count() == 7 and read[0].where("page like '%/other%'").isEmpty()
