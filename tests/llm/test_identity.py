from orbitlake.llm.pii_spans import spans


def numbers(text):
    return [i for _, k, i, *_ in spans(text) if k == "id_number"]


def test_labels_close_together():
    assert numbers("SSN 924887021. The badge 61579444Y was lost.") == ["924887021", "61579444Y"]
    assert numbers("SSN 729096-8577. The badge 45 478 097 661 was lost.") == ["729096-8577", "45 478 097 661"]
    assert numbers("DNI 61579444Y NIF 61579445Z SSN 924887021 DNI 61579446A") == ["61579444Y", "61579445Z", "924887021", "61579446A"]
