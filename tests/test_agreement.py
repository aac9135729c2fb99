"""Readings of regions: what agrees, what conflicts, and what is trusted."""

NATIVE, OCR, SEEN, MATH = ("mupdf_native", None), ("paddle_ocr", "paddle"), ("some_vlm", None), ("formula_net", None)


def reading(record, kind, index, engine, text, status="ok", same=True, bound=True, faults=None):
    return record, kind, index, *engine, text, status, same, bound, faults


def test_buckets(spark):
    from quill.operators.agreement import cross_validated

    rows = [
        reading(1, "text", 0, NATIVE, "one  two\n3"), reading(1, "text", 1, OCR, "one two 3 "),
        reading(2, "text", 0, NATIVE, "a = 4"), reading(2, "text", 1, OCR, "a = 5"),
        reading(3, "text", 0, ("tesseract_ocr", "paddle2"), "same"), reading(3, "text", 1, OCR, "same"),
        reading(4, "code", 0, NATIVE, "x"), reading(4, "code", 1, OCR, "x"),
        reading(5, "text", 0, NATIVE, "x"), reading(5, "text", 1, OCR, "x", same=False),
        reading(6, "formula", 0, NATIVE, "E"), reading(6, "formula", 1, MATH, "\\frac"), reading(6, "formula", 2, OCR, "F"),
        reading(7, "text", 0, NATIVE, " ", bound=None), reading(7, "text", 1, OCR, None, status="pending"),
        reading(8, "text", 0, NATIVE, "x", status="failed"), reading(8, "text", 1, OCR, "y", faults=["mojibake", "empty_cells"]),
        reading(9, "text", 0, NATIVE, "x", bound=False), reading(9, "text", 1, OCR, "x"),
        reading(10, "image", 0, OCR, "label"), reading(10, "image", 1, SEEN, "A drawing of a label"),
        reading(11, "text", 0, NATIVE, "x"), reading(11, "text", 1, OCR, "x"), reading(11, "text", 2, ("other_ocr", "other"), "z"),
        reading(None, "text", 0, NATIVE, "x"), reading(None, "text", 1, OCR, "x", same=None),
    ]
    schema = "record int, kind string, `index` int, engine string, family string, text string, status string, same_source boolean, bound boolean, faults array<string>"
    got = {r["record"]: r for r in cross_validated(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    assert {k: r["bucket"] for k, r in got.items()} == {1: "trusted", 2: "uncertain", 3: "uncertain", 4: "uncertain", 5: "critical", 6: "uncertain", 7: "uncertain", 8: "critical", 9: "uncertain", 10: "uncertain", 11: "uncertain", None: "critical"}
    assert (got[1]["proposed"], got[1]["engine"], got[1]["family"], got[1]["agreeing"], got[1]["reasons"]) == ("one  two\n3", "mupdf_native", "native_pdf", 1, [])
    assert got[2]["reasons"] == ["independent_extractors_disagree", "no_independent_exact_transcript_confirmation", "numeric_or_sign_disagreement"]
    # two optical readings of one family confirm nothing, and no conflict either
    assert (got[3]["agreeing"], got[3]["conflicts"]) == (0, 0)
    assert got[4]["agreeing"] == 1 and got[4]["reasons"] == ["high_risk_requires_human_review"]
    assert (got[6]["engine"], got[6]["conflicts"]) == ("formula_net", 0)
    assert got[7]["reasons"] == ["extraction_pending"] and got[7]["proposed"] is None
    assert got[8]["reasons"] == ["candidate_empty_cells", "candidate_mojibake", "no_usable_extraction"] and got[8]["rejected"] == 2
    assert "selected_candidate_region_evidence_unbound" in got[9]["reasons"] and got[9]["agreeing"] == 0
    assert (got[10]["engine"], got[10]["reasons"]) == ("some_vlm", ["vlm_description_requires_source_review"])
    assert (got[11]["agreeing"], got[11]["conflicts"]) == (1, 1)
    assert cross_validated(spark.createDataFrame([], schema)).count() == 0
