import pytest

from chatloom import registry
from chatloom.operators.encoding import special_tokens


def test_codes():
    want = {"<image>": -1626, "<speech>": -8565, "<sound>": -9634, "<video>": -8680, "<imagebind>": -2755, "<document>": -7240}
    assert {t: registry.token_code(t) for t in want} == want


def test_patches():
    assert registry.patch_count(336, 14) == 576


def test_bundles_can_be_combined_and_extended():
    assert [s.token for s in registry.bundle("vision_clip_pool", "document_gte")] == ["<image>", "<document>"]
    mine = registry.ModalitySpec("toy", "<toy>", "toys", 3)
    try:
        assert registry.register_modality(mine) is mine
        assert registry.bundle("toy", "audio_clap")[0] is mine
        with pytest.raises(ValueError):
            registry.register_bundle("toy", [mine])
    finally:
        registry.BUNDLES.pop("toy", None)


def test_bad_specs_are_rejected():
    with pytest.raises(ValueError):
        registry.bundle("vision_clip", "vision_clip_pool")
    with pytest.raises(ValueError):
        registry.check_specs([registry.ModalitySpec("a", "<a>", "as", 0)])
    with pytest.raises(ValueError):
        registry.check_specs([registry.ModalitySpec("a", "", "as", 1)])


def test_special_token_defaults():
    assert special_tokens({"unk": 0, "pad": None, "sep": 9}) == {"unk": 0, "pad": 0, "mask": 0, "cls": 0, "sep": 9}


def test_spec_table(spark):
    rows = {r["bundle"]: r for r in registry.spec_table(spark).collect()}
    assert rows["vision_clip"]["width"] == 576 and rows["document_gte_x16"]["width"] == 32
