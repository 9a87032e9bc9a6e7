"""Ranks of hosts that are many links or a cycle away from the seeds."""

import numpy as np
import pytest

from gemello.llm import url_graph

RULES = [url_graph.Rule("bad.org", "/", False)]


@pytest.mark.parametrize("one_task", [0, url_graph.ONE_TASK])
def test_ranks_converge_over_long_chains_cycles_and_links_without_scheme(spark, monkeypatch, one_task):
    monkeypatch.setattr(url_graph, "ONE_TASK", one_task)
    hosts = ["bad.org"] + [f"h{k}.io" for k in range(1, 13)]
    links = {a: [b] for a, b in zip(hosts[1:], hosts, strict=False)} | {"bad.org": ["h2.io"], "h3.io": ["h2.io", "h5.io"]}
    pages = [(k, f"http://{h}/", "".join(f'<a href="//{t}/x?u=http://other.io/">' for t in links[h])) for k, h in enumerate(hosts)]
    got = {r.host: r.distrust for r in url_graph.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    at = {h: k for k, h in enumerate(hosts)}
    counts = np.zeros((len(hosts), len(hosts)))
    for src, targets in links.items():
        for t in targets:
            counts[at[src], at[t]] += 1
    m = counts / np.maximum(counts.sum(axis=0), 1)  # reversed edges, shares of each target
    want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, 0.15 * np.eye(len(hosts))[0])
    assert want[-1] > 1e-3
    assert all(abs(got[h] - want[at[h]]) < 1e-8 for h in hosts)
