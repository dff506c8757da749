from leafstrata.functions.scalars import encoder_flags, register


def test_sql_functions(spark):
    assert "page_luma" in register(spark)
    (r,) = spark.sql(
        "SELECT page_luma(255, 255, 255) a, normal_level(100, 0) b, normal_level(100, 200) c, point_to_pixel(36.13F, 300F) d, mask_colour(1) e, is_cjk('a漢') f, is_cjk(NULL) g,"
        " file_stem('a.b.pdf') h, byte_size(512) i, byte_size(1536) j, byte_size(1572864) k, producer_chain(' ', 'P') l, producer_chain('X', 'P') m,"
        " shorten('abcdef', 3) n, shorten(NULL, 3) o, setting_int('x', 7) p, setting_double('0.50', 1D) q, setting_boolean('TRUE', false) s, setting_boolean(NULL, true) t"
    ).collect()
    assert tuple(r) == (255, 100, 127, 151, -16777216, True, False, "a.b", "512 B", "2 KB", "1.5 MB", "P", "X -> P", "abc…", "", 7, 0.5, True, True)


def test_encoder_flags():
    assert encoder_flags(" -p  -b out -s ") == ["-p", "-s"] and encoder_flags("-b") == []
