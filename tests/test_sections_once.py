from lodestrata.operators.sections import markdown_sections


def test_sections_are_made_once(spark):
    """Sections are looked for once a file, and files with none are one record still."""
    rows = [("a.md", "# One\nbody\n## Two\n\n# Three\nmore"), ("b.md", "# Only a heading"), ("c.md", ""), ("d.md", None), ("e.md", "before\n# H\nafter")]
    found = markdown_sections(spark.createDataFrame(rows, "source_file string, text string"))
    got = sorted(map(tuple, found.select("source_file", "title", "raw_text", "row_or_page").collect()))
    assert got == [
        ("a.md", "One", "One\nbody", "section 1"), ("a.md", "Three", "Three\nmore", "section 3"), ("b.md", "b", "# Only a heading", "page 1"), ("c.md", "c", "", "page 1"), ("d.md", "d", "", "page 1"),
        ("e.md", "H", "H\nafter", "section 1"), ("e.md", "e", "e\nbefore", "section 0"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(" in plan and "CASE WHEN (size(" not in plan.partition("Generate explode(")[2]
