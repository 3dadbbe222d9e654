import json

import pytest

from varguard.sources.text import apply_metadata, read_labelled_text, read_metadata, read_text_groups, sensitive_columns


def test_labelled_csv_with_quotes_commas_and_newlines(spark, tmp_path):
    path = tmp_path / "labelled.csv"
    path.write_text(
        'acl.id,text,label,split\n'
        'a1,"plain text",0,train\n'
        'a2,"has, comma and ""quotes""",1,dev\n'
        'a3,"two\nlines",1,train\n'
    )
    df = read_labelled_text(spark, str(path))
    rows = {r["acl.id"]: r for r in df.collect()}
    assert rows["a2"].text == 'has, comma and "quotes"' and rows["a2"].label == 1
    assert rows["a3"].text == "two\nlines"
    assert df.filter("split = 'train'").count() == 2


def test_malformed_rows_fail_instead_of_vanishing(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("acl.id,text,label,split\na1,x,not_a_number,train\n")
    with pytest.raises(Exception):
        read_labelled_text(spark, str(path)).collect()


def test_metadata_selects_declared_columns_and_flags_sensitive(spark, tmp_path):
    meta_path = tmp_path / "meta.json"
    meta_path.write_text(json.dumps({"all_col_names": ["acl.id", "text", "label"], "sensitive_col_names": ["label"]}))
    meta = read_metadata(spark, str(meta_path))
    df = spark.createDataFrame([("1", "t", 0, "x")], "`acl.id` string, text string, label int, extra string")
    out = apply_metadata(df, meta)
    assert out.columns == ["acl.id", "text", "label"]
    assert sensitive_columns(out) == ["label"]
    with pytest.raises(ValueError):
        apply_metadata(df.drop("text"), meta)


def test_text_groups_json(spark, tmp_path):
    path = tmp_path / "groups.json"
    path.write_text('{"group_id": 1, "text_groups": ["he is here", "she is here"]}\n{"group_id": 2, "text_groups": ["x"]}\n')
    got = {r.group_id: r.text_groups for r in read_text_groups(spark, str(path), "json").collect()}
    assert got == {1: ["he is here", "she is here"], 2: ["x"]}
