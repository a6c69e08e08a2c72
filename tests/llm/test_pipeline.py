"""The pipeline against brute force, stage by stage on its own input."""
import corpus_pipeline as C
from sparkmem.llm.queries import tokenizer_path
from tests.conftest import SF001
from tests.llm.test_first_ops import ODD, brute_components, brute_fp
from tests.llm.test_suffix import brute


def test_stages_against_brute_force(spark):
    import sentencepiece
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    low = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 0").collect()}
    kept = []
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, SF001), "test-" + name)
        after = {r.doc_id: r for r in docs.collect()}
        kept.append(len(after))
        assert set(after) <= set(before)
        if name != "pieces":
            assert docs.columns == C.COLUMNS
        if name == "quality":
            gone = set(before) - set(after)
            labelled = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
            assert len((gone & labelled) - low) <= 1 and len(low & before.keys() - gone) <= 3
        elif name == "near_duplicates":
            ids = sorted(before)
            fp = {i: brute_fp(before[i].text) for i in ids}
            comp = brute_components(ids, [(i, j) for i in ids for j in ids if j < i and (fp[i] ^ fp[j]).bit_count() <= 3])
            assert set(after) == {i for i in ids if comp[i] == i} and all(after[i] == before[i] for i in after)
        elif name == "repeated_passages":
            ids = sorted(before)
            for i, (n, gone, _, _) in zip(ids, brute([(i, before[i].text) for i in ids])):
                assert (i in after) == (gone == 0 or gone < n)
                if i in after:
                    assert n - gone - 6 <= len(after[i].text.encode()) <= n - gone
                    assert gone or after[i] == before[i]
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
            held = {i for i, r in before.items() if any(t in r.text for t in items)}
            gone = set(before) - set(after)
            assert held <= gone and len(gone - held) <= 1
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
            assert set(after) == set(before)
            assert all(after[i].piece_ids == lib.encode(before[i].text) and after[i].round_trip for i in after)
        before = after
    assert kept == sorted(kept, reverse=True)


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, None, "s", None, 1) for i, t in enumerate(ODD)] + [(None, None, None, None, None, 2)] * 2 + [(3, "a", None, "s", None, 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, SF001), "odd-" + name)
    assert docs.count() > 0
    empty = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        empty = C.written(stage(spark, empty, SF001), "none-" + name)
    assert empty.count() == 0
