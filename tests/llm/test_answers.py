import pytest

from noctiluca.llm.answers import defective, defects, flag_pairs

Q = "How old are the brown dwarfs discovered in Solvanne nebula?"


@pytest.mark.parametrize("answer", [None, "", "  ", "\u200b", "\xa0", "N/A", "n/a", "null", "...", "-", "?", "TBD", "(no answer)", "none given", "<p></p>"])
def test_empty(answer):
    assert defects(Q, answer) == ["empty"]


@pytest.mark.parametrize("answer", ["It drops slowly because of the", "They formed (see", "Most authors invoke dust,", "The most plausible mec", "It redistributes material and thereby", "A detection beyond 3 kpc would be hard to recon", "Ils se sont formés tôt à cause de la", "Dieser Vorgang verteilt das Gas wegen der", "Se comparan imágenes de noches y se debido a la", "It declines abruptly, from..."])
def test_truncated(answer):
    assert "truncated" in defects(Q if answer[0] not in "IDS" or answer.startswith("It") else None, answer)


@pytest.mark.parametrize("answer", ["I'm sorry, but I can't help with that question.", "I cannot answer this request.", "I would rather not comment on this topic.", "My apologies, I am unable to assist with Karveth Ring.", "Unfortunately I don't have enough information to respond to this.", "As an assistant I am not able to provide an answer on this.", "I must decline to answer, as the matter is beyond my remit.", "It is not possible for me to answer this; please consult the literature."])
def test_refusal(answer):
    assert defects(Q, answer) == ["refusal"]


@pytest.mark.parametrize(("question", "answer"), [("Wie alt sind die Sterne in der Wolke?", "Diese Frage kann ich leider nicht beantworten."), ("Pourquoi ces disques sont-ils si anciens ?", "Je suis désolé, je ne peux pas répondre à cette question."), ("¿Por qué son tan antiguos los discos?", "No estoy en condiciones de ayudar con este tema.")])
def test_refusal_in_other_languages(question, answer):
    assert defects(question, answer) == ["refusal"]


@pytest.mark.parametrize("answer", [Q, Q.upper(), "  " + Q.replace(" ", "  ") + "\n", "The question is: " + Q, Q + " " + Q, Q.rstrip("?") + "."])
def test_copy(answer):
    assert defects(Q, answer) == ["question_copy"]


@pytest.mark.parametrize("answer", ["Sie entstanden früh und wurden durch Staubabsetzung kaum verändert.", "Ils se sont formés tôt et n'ont guère été modifiés depuis.", "Se formaron pronto y apenas han cambiado desde entonces."])
def test_other_language(answer):
    assert defects(Q, answer) == ["other_language"]


def test_other_script():
    assert "other_language" in defects(Q, "Они образовались рано и с тех пор почти не изменились.")


@pytest.mark.parametrize("answer", ["About 8.14 Gyr", "- bar buckling\n- core collapse\n- secular growth", "The distance cannot be measured directly, so a matched filter is used and yields 3.46 kpc.", "Models are unable to produce such clouds without infall, which is why it is invoked.", Q + " About 7.88 Gyr", Q + " They formed early.", Q + " - radiative cooling\n- phase mixing", "Isochrone ages cluster around 8.79 Gyr (with scatter)."])
def test_sound(answer):
    assert defects(Q, answer) == []


def test_without_question():
    assert defects(None, "They formed early.") == []
    assert defects("", "because of the") == ["truncated"]


def test_all_that_apply_in_order():
    assert defects(Q, "Diese Frage kann ich leider nicht beantworten, weil") == ["refusal", "other_language", "truncated"]


def test_table(spark):
    schema = "id string, question string, reference_answer string, defect string, answer string"
    rows = [("a", Q, None, "x", "y"), ("a", Q, None, "x", "y"), ("b", Q, "About 3 Gyr", "x", "y"), ("c", None, None, None, None), (None, Q, "", None, None), ("d", Q, "word " * 100_000 + ".", "x", "y")]
    df = spark.createDataFrame(rows, schema)
    assert flag_pairs(df).count() == 6
    assert {(r["id"], r["defect"]) for r in defective(flag_pairs(df)).collect()} == {("a", "empty"), ("c", "empty")}
    assert flag_pairs(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("answer", ["No", "No.", "Yes", "Missing", "Unknown.", "Nein.", "Ja", "Non.", "Oui", "Keine", "Sí", "Ninguna", "None of them.", "Yes indeed", "Only near the centre", "Both of them", "Some dust and gas", "Gravitational lensing by foreground galaxy clusters", "Adaptive optics with a laser guide star", "The cosmic microwave background", "I do not give the detector a bias; I know the information from flats is enough."])
def test_short_answers_are_answers(answer):
    assert defects("Is it?", answer) == []


@pytest.mark.parametrize(("question", "answer"), [("Sind die Sterne in der Wolke anders als die in der Scheibe?", "Ich kann nicht sehen, dass es anders ist."), ("Pourquoi ces disques sont-ils si anciens ?", "Je ne sais pas si la poussière est chaude, mais elle est visible.")])
def test_doubt_is_no_refusal(question, answer):
    assert defects(question, answer) == []


@pytest.mark.parametrize("answer", ["Le stelle si sono formate presto e non sono cambiate da allora.", "As estrelas foram formadas cedo e não mudaram desde então.", "De sterren zijn vroeg ontstaan en daarna niet meer veranderd."])
def test_languages_that_are_not_asked_in(answer):
    assert defects("How old are the stars that are found in the outer disc?", answer) == ["other_language"]


@pytest.mark.parametrize("answer", ["Isochrone ages cluster around 7.78 Gyr with a scatter of", "It drops. A gradient in stellar age", "They were formed early and have not", "A detection would be hard to recon"])
def test_broken_off(answer):
    assert defects(Q, answer) == ["truncated"]


def test_first_defect_of_a_repeated_id(spark):
    rows = [("a", Q, Q), ("a", Q, "I cannot answer this request."), ("b", Q, None), ("b", Q, "It drops because of the")]
    df = spark.createDataFrame(rows, "id string, question string, reference_answer string")
    assert {(r["id"], r["defect"]) for r in defective(flag_pairs(df)).collect()} == {("a", "question_copy"), ("b", "empty")}
