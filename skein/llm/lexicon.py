"""Function words of the languages in use, by falling frequency."""

from __future__ import annotations

# Fixed values (common closed-class words; the order is roughly by frequency).
FUNCTION_WORDS: dict[str, tuple[str, ...]] = {
    "en": tuple("the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through where how while because although both each every neither nor why under near since".split()),
    "de": tuple("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn ob weil nicht heute oft zuerst dann".split()),
    "fr": tuple("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son sa mais comme on tout nous sa être cette ses aux ont fait leur si quand avait personne sans entre aussi dit non souvent parfois seulement".split()),
    "es": tuple("de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo solo hay sino nadie dice".split()),
    "it": tuple("di e il la che in a per un è del non una sono le si con da della al i come più lo ma ha anche dei nel alla gli dal su se o delle questo ad nella quando ed era dalla sua suo essere ci dopo tra fra solo perché nessuno dice".split()),
    "pt": tuple("de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ninguém dizem havia".split()),
    "nl": tuple("de van het een en in is dat op te zijn met voor niet aan er die als door om ook bij uit naar dan maar wordt over nog ze heeft had tot worden of werd meer al deze was hij waar kan dit toch wat zij niemand hoe toen vaak".split()),
    "ru": tuple("и в не на что с он как это по но из у к за то же от все так его для о а бы когда или мы до была если уже был даже там только мне было вот при где нет себя чем кто никто потому поэтому над без между также чтобы ещё тоже через под после".split()),
}

LANGUAGES = tuple(sorted(FUNCTION_WORDS))

# Labels that name a language, beside the two-letter code.
LANGUAGE_NAMES: dict[str, tuple[str, ...]] = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français"),
    "es": ("spa", "spanish", "español", "castilian"),
    "it": ("ita", "italian", "italiano"),
    "pt": ("por", "portuguese", "português"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "ru": ("rus", "russian", "русский"),
}

_BY_LABEL = {name: code for code, names in LANGUAGE_NAMES.items() for name in (code, *names)}


def label_language(label: str | None) -> str | None:
    """Two-letter code that a label names; null, blank and unknown labels name none."""
    text = (label or "").strip().lower().replace("_", "-")
    return _BY_LABEL.get(text) or _BY_LABEL.get(text.split("-")[0])
