"""Rules over host labels that stand between the first and the last two."""

from auditframe.llm import urls


def test_every_label_of_a_host_is_a_token(spark):
    frame = spark.createDataFrame([(1, "https://m.casino-win.example.com/a"), (2, "https://pills.net/"), (3, None)], "page_id long, url string")
    found = {r.page_id: set(r.tokens) for r in urls.with_tokens(frame, "url").collect()}
    assert {"label:m", "label:casino-win", "label:example", "label:com", "domain:example.com", "domain:casino-win.example.com", "host:m.casino-win.example.com"} <= found[1]
    assert {"label:pills", "label:net", "domain:pills.net"} <= found[2] and found[3] == {"host:"}


def test_a_label_between_is_learned_across_prefixes(spark):
    rows = [(f"https://p{i}.casino-win.host{i}.com/x{chr(97 + i)}", True) for i in range(12)]
    rows += [(f"https://p{i}.garden.host{i}.com/x{chr(97 + i)}", False) for i in range(12)]
    labels = spark.createDataFrame(rows, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "https://new.casino-win.other.org/z"), (2, "https://new.garden.other.org/z")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, labels, []).collect()} == {1: "block", 2: "allow"}
