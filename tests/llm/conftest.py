import pytest


@pytest.fixture(scope="session")
def languages():
    """A classifier from a few sentences of each language."""
    from strandline.llm.pairs import LanguageModel

    texts = {
        "en": "the speaker wants to know what the others think about this plan and whether they will come with her to the meeting tomorrow "
        "she has a red ball and the cat sat on the bed while they all eat near the table can the dog play "
        "researchers who examined the conditions reported that intention generally decreases when speakers anticipate interruption "
        "whether alignment can be measured reliably remains a controversial question since experimental conditions vary considerably",
        "de": "die sprecherin möchte wissen was die anderen über diesen plan denken und ob sie morgen mit ihr zur besprechung kommen werden",
        "es": "la persona quiere saber qué piensan los demás sobre este plan y si mañana van a ir con ella a la reunión del grupo",
        "fr": "la personne veut savoir ce que les autres pensent de ce plan et si demain ils viendront avec elle à la réunion du groupe",
        "nl": "de spreker wil graag weten wat de anderen van dit plan vinden en of ze morgen met haar mee naar de vergadering gaan",
    }
    return LanguageModel([f"{t} {t}" for t in texts.values()], list(texts))
