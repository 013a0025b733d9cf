from lineagelake.functions.register import register


def test_functions_in_sql(spark):
    register(spark)
    row = spark.sql(
        "SELECT hamming_distance('ACGT', 'ACGA') h, qc_fraction('II##', 20, 33) q, kmers('ACACG', 2) k, infix_edit_distance('ACGT', 'TTACTTT') i, "
        "trim_adapter('ACGTTCGT', 'ACGT', '', 0.1D) t, find_reference('ACGTGCTAGCAT', array('ACGC', 'GCTAAA'), 1) f"
    ).first()
    assert (row.h, row.q, row.k, row.i, row.t, row.f) == (1, 0.5, ["AC", "CA", "CG"], 1, "TCGT", "ACGC")
