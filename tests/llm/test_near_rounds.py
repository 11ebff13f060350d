import pytest

from sieveline.llm import components


@pytest.mark.parametrize("links, rounds", [([(0, i) for i in range(1, 9)], 0), ([(9, i) for i in range(9)] + [(20, 21)], 1)],
                         ids=["smallest in the middle", "largest in the middle"])
def test_a_star_takes_no_round_that_changes_nothing(spark, monkeypatch, links, rounds):
    written, write = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df, label: written.append(label) or write(df, label))
    got = {r.node: r.label for r in components.smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: 20 if x >= 20 else 0 for pair in links for x in pair}
    assert written == ["links", "labels"] + ["lower", "labels"] * rounds
