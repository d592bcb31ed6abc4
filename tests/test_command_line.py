from rookery.__main__ import main
from rookery.sources import records as R


def test_from_files_to_scores(spark, tmp_path, capsys):
    names = ["Acme Foods", "Blue River Mills", "Orange Tree Traders", "Stone Works", "Green Hill Farms", "Silver Lake Motors"]
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "s1.tsv").write_text(head + "".join(f"S1-{i}\t{n} Inc\t{i} Elm St\tUS\n" for i, n in enumerate(names)))
    (tmp_path / "s2.tsv").write_text(head + "".join(f"S2-{i}\t{n.upper()}\t{i} Elm Street\tus\n" for i, n in enumerate(names)))
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tS2-{i}\n" for i in range(len(names))))
    p = lambda n: str(tmp_path / n)
    recs = ["--records", p("s1.tsv"), p("s2.tsv")]
    main(["block", *recs, "--out", p("cands")], spark)
    found = {(r.s1_id, r.cand_id) for r in R.read_long_pairs(spark, p("cands")).collect()}
    assert {(f"S1-{i}", f"S2-{i}") for i in range(len(names))} <= found
    main(["wide", *recs, "--candidates", p("cands"), "--out", p("wide")], spark)
    assert R.read_tsv(spark, p("wide"), R.WIDE).count() == len(names)
    main(["recall", "--candidates", p("cands"), "--truth", p("truth.tsv")], spark)
    assert "1.0" in capsys.readouterr().out
    preds = R.read_long_pairs(spark, p("cands")).selectExpr("s1_id as s1_entity_id", "cand_id as candidate_entity_id", "least(score, 0.99D) as prob")
    preds.write.options(sep="\t", header=True).csv(p("preds"))
    main(["submit", *recs, "--predictions", p("preds"), "--out", p("results")], spark)
    main(["evaluate", *recs, "--results", p("results"), "--truth", p("truth.tsv")], spark)
    assert "macro_f05" in capsys.readouterr().out
