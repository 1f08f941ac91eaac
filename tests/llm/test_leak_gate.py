from ledgerfold.llm.leakage import ItemIndex, leaks, terms, words
from tests.llm.test_texts import ITEM, OTHER

MANY = "Explain how the {0} regulator keeps order while {8} pumps {9} vents {10} seals {11} gears {12} belts {13} rods work beside {1}, {2}, {3}, {4}, {5}, {6} and {7}."


def _index():
    alike = [(100 + i, base.replace("hosozudota", f"ranome{i}dul").replace("novutewuras", f"bisuke{i}lon").replace("caberamecor", f"vodina{i}fir").replace("mazidihiro", f"tugewa{i}bas").replace("311", str(500 + i)).replace("191", str(600 + i))) for i, base in enumerate([ITEM, OTHER] * 6)]
    # items of many names, all but one of them in the second half, and of figures in the first; the other words are common
    names = ["zarotupeni", "gopatirune", "felomasidu", "kibanoture", "dosaverimo", "lepunagito", "rumakesobi", "tivadolenu"]
    long = [MANY.format(*(f"{x}{'abcdefg'[k]}" for x in names), *range(411 + 9 * k, 419 + 9 * k)) for k in range(7)]
    many = long[0]
    alike += [(200 + k, x) for k, x in enumerate(long[1:])]
    return ItemIndex([*alike, (1, ITEM), (2, OTHER), (3, many)]), many


def test_figures_are_pivots():
    index, many = _index()
    passage = " ".join(many.split()[:22])
    assert {index.ids[i] for i in leaks(index, passage)} == {3}


def test_all_items_of_the_share_are_retrieved():
    index, many = _index()
    for text in (ITEM, OTHER, many):
        w = text.split()
        for s in range(0, len(w), 3):
            query = terms(words(" ".join(w[s : s + len(w) // 2]).lower()))
            want = [i for i, own in enumerate(index.impacts) if sum(v for t, v in own.items() if t in query) >= index.threshold]
            assert index.retrieve(query, index.candidates(query)) == want
            assert index.retriever(list(range(len(index.ids))), query)(query) == want
