"""Refusals: an automaton over kinds of phrases (negated ability or will, answering verbs, what is asked, and the like)."""

from __future__ import annotations

import re

import ahocorasick

_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words(text: str) -> list[str]:
    return [w.replace("’", "'").lower() for w in _WORDS.findall(text)]


#: Phrases by what they do in a refusal, in English, French, German and Spanish.
KINDS = {
    # negated ability or will
    "neg": """cannot|can not|can't|could not|couldn't|unable to|am unable|not able to|incapable of|won't|will not|would not|wouldn't|shall not|not possible|isn't possible|impossible|not in a position to|rather not|
    prefer not to|not going to|choose not to|chosen not to|choosing not to|not permitted to|not allowed to|do not wish to|don't wish to|do not want to|don't want to|not willing to|unwilling to|not prepared to|not authorised to|not authorized to|must not|should not|
    do not intend to|don't intend to|not feel able to|not comfortable|hesitant to|reluctant to|no way to|not feasible|isn't feasible|refrain from|not to|inappropriate for me to|inappropriate for us to|inappropriate to|not appropriate to|not allow me to|not allow us to|not let me|not let us|not permit me to|not enable me to|not allow an|
    ne peux pas|ne peut pas|ne peux|ne pouvons|ne pouvons pas|ne saurais|ne saurait|ne saurions|ne souhaite pas|ne souhaitons pas|ne veux pas|ne voulons pas|pas en mesure de|pas possible|impossible|ne pas pouvoir|ne pourra pas|ne pourrons pas|incapable de|préfère ne pas|préférons ne pas|
    nicht in der lage|nicht imstande|nicht bereit|unmöglich|nicht möglich|kann nicht|können nicht|möchte nicht|möchten nicht|will nicht|wollen nicht|darf nicht|dürfen nicht|nicht|außerstande|
    no puedo|no podemos|no puede|no poder|no podré|no podremos|no se puede|no es posible|no nos es posible|no me es posible|imposible|no estoy en condiciones de|no estamos en condiciones de|no quiero|no queremos|no deseo|no deseamos|prefiero no|preferimos no""",
    "not mine": "not something i|not something we|not something that i|not for me to|not for us to|no me corresponde|no nos corresponde|ce n'est pas à moi de|es steht mir nicht zu|nicht befugt|not my place to",
    # verbs that say all by themselves
    "say": """answer|answering|respond|responding|reply|replying|comment|commenting|speculate|speculating|help|assist|write about|write on|address|discuss|stellung zu nehmen|stellung nehmen|
    répondre|commenter|traiter|aider|me prononcer|nous prononcer|beantworten|antworten|helfen|äußern|weiterhelfen|eingehen|responder|responderle|contestar|comentar|ayudar|ayudarle|opinar|pronunciarme|pronunciarnos""",
    # verbs that only speak, whatever they are about
    "talk": "offer a view|give a view|give an opinion|offer an opinion|comment on|commenting on|speculate|speculating|write about|writing about|express a view|take a position|me prononcer|nous prononcer|mich äußern|uns äußern|mich dazu nicht äußern|pronunciarme|pronunciarnos",
    # verbs that need something made by them
    "make": """provide|providing|give|giving|write|writing|draft|drafting|produce|producing|offer|offering|prepare|supply|formulate|complete|compose|generate|make|submit|put together|come up with|
    fournir|rédiger|donner|proposer|formuler|apporter|geben|verfassen|schreiben|liefern|machen|erstellen|formulieren|abgeben|dar|redactar|ofrecer|proporcionar|facilitar|elaborar|formular""",
    "text": """answer|answers|response|responses|reply|replies|draft|drafts|text|statement|statements|comment|commitment|commitments|wording|passage|submission|anything|réponse|texte|commentaire|rédaction|antwort|stellungnahme|stellung|aussage|angaben|entwurf|auskunft|respuesta|texto|comentario|contestación|redacción""",
    "none": "no|without any|not any|aucune|aucun|pas de|keine|keinen|keinerlei|ninguna|ningún|sin|no hay",
    "nothing": "nothing|rien|nichts|nada",
    "said": "said about this|said here|said on this|stated here",
    "made": """written|given|offered|possible|provided|drafted|made|supplied|available|prepared|forthcoming|submitted|attempted|proposed|follows|produced|
    donnée|fournie|possible|rédigée|proposée|apportée|formulée|gegeben|gemacht|geben|möglich|abgegeben|verfasst|vorgelegt|genommen|bezogen|posible|ofrece|ofrecida|dada|dar|redactar|redactada|proporciona|facilita""",
    "ask": """question|requirement|item|point|request|prompt|query|section|clause|this|that|it|here|this for you|that for you|it for you|cette|ce|cela|ceci|y|exigence|point|demande|frage|anforderung|punkt|diese|dieser|dieses|dazu|darauf|hierzu|das|pregunta|requisito|punto|esta|este|ello|esto|eso|solicitud|petición""",
    "not be": "not be|never be|cannot be|can't be|won't be|not been|ne sera pas|ne peut être|ne peut pas être|nicht|no será|no puede ser|no se puede|no se",
    "this": "this|that|it|here|cette|ce|cela|ceci|diese|dieser|dieses|dazu|darauf|hierzu|das|esta|este|ello|esto|eso",
    "not made": "not possible|not available|not forthcoming|nicht möglich|nicht verfügbar|pas possible|no es posible|no está disponible",
    "not given": "no hay|no habrá|no se ofrece|no se da|no se dará|no se facilita|no se aporta|il n'y a pas de|il n'y aura pas de|je n'ai pas de|nous n'avons pas de|es gibt keine|es wird keine|ich habe keine|wir haben keine|there is no|there will be no|we have no|i have no|we offer no|i offer no",
    "done": "answered|fulfilled by me|processed by me|commented on|addressed|responded to|completed|attempted|dealt with|drafted|traitée|traité|répondue|beantwortet|bearbeitet|respondida|respondido|contestada|contestado|responder|contestar",
    "leave": "leave|leaving|left|leaves|remain|remains|laisse|laissons|laissée|laissé|reste|restera|demeure|wird|quedará|lasse|lassen|bleibt|dejo|dejamos|queda|deja",
    "unsaid": "unanswered|blank|without an answer|without a response|sans réponse|unbeantwortet|offen|sin respuesta|en blanco|sin contestar",
    "decline": "decline|declines|declined|declining|refuse|refuses|refused|excuse me from|excuse us from|decided against|abstain|pass on|opt out of|décline|déclinons|refuse de|refusons|m'abstiens|ablehnen|lehne|lehnen|verweigere|verzichte|declino|declinamos|declinar|rehúso|rehusamos|me niego|me abstengo",
    "rules": "guidelines|policy|policies|instructions|rules|terms|consignes|règles|richtlinien|vorgaben|regeln|directrices|normas|instrucciones",
    "bar": "do not let|don't let|does not let|do not allow|don't allow|does not allow|doesn't allow|prevent|prevents|prohibit|prohibits|forbid|forbids|do not permit|does not permit|stop me|stops me|stop us|keep me|interdisent|empêchent|ne me permettent pas|verbieten|erlauben mir nicht|lassen es nicht zu|no me permiten|me impiden|prohíben|against",
    "beyond": "outside|beyond|exceeds|dépasse|dépassent|übersteigt|not within|out of|au delà|hors de|außerhalb|fuera de|excede",
    "remit": "my remit|our remit|my scope|my role|my competence|my authority|my expertise|my capabilities|what i can|what i am able|what i'm able|ma compétence|mon mandat|mes compétences|meiner zuständigkeit|meines auftrags|mi competencia|mi ámbito|mis competencias",
    "self": "as an ai|as a language model|as an assistant|i am an ai|i'm an ai|i am just an ai|i'm just an ai|en tant qu'ia|en tant qu'assistant|als ki|als assistent|als sprachmodell|como ia|como asistente|como modelo de lenguaje",
    "lack": "lacks|lacking|there is not enough|there is too little|mir fehlen|uns fehlen|i do not have|we do not have|i don't have|we don't have|do not have enough|don't have enough|i lack|we lack|not enough|insufficient|je n'ai pas|nous n'avons pas|fehlen mir|fehlen uns|habe ich nicht|haben wir nicht|no tengo|no tenemos|no dispongo|carezco",
    "facts": "facts to|facts|information|details|material|data|evidence|basis|context|knowledge|faits|informations|d'informations|d'éléments|éléments|angaben|informationen|fakten|grundlage|datos|información|elementos",
    "attempt": "attempt|try|effort|tentative|versuch|intento",
    "pass": "left for|left to|leave for|leave to|leave this to|leave it to|leave that to|best left to|hand over to|defer to",
    "person": "bid manager|bid team|bid lead|manager|human|person|colleague|colleagues|expert|experts|specialist|specialists|someone|author|team|buyer",
    "no comment": "no comment|no response|no reply|no answer|pass|sans commentaire|pas de réponse|pas de commentaire|kein kommentar|keine antwort|sin comentarios|sin respuesta",
}
END = "$"

#: Kinds in order, with the words that may stand between each and the next; $ is the sentence's end.
RULES: tuple[tuple[str | int, ...], ...] = (
    ("neg", 4, "say", 4, "ask"), ("ask", 6, "neg", 3, "say"), ("neg", 5, "say", 0, END), ("neg", 3, "talk"), ("neg", 5, "make", 4, "text"), ("neg", 3, "make", 1, "ask", 0, END),
    ("neg", 4, "text", 3, "make"), ("neg", 4, "text", 3, "made"), ("text", 3, "neg", 2, "made"), ("none", 3, "text", 5, "made"), ("none", 3, "text", 4, "make"), ("nothing", 2, "made"), ("nothing", 3, "say"), ("nothing", 4, "said"),
    ("text", 4, "not made"), ("text", 3, "not be", 3, "made"), ("not given", 1, "text"),
    ("ask", 4, "not be", 3, "done"), ("ask", 6, "leave", 4, "unsaid"), ("leave", 2, "ask", 3, "unsaid"), ("ask", 6, "unsaid", 2, "leave"),
    ("decline", 3, "say"), ("decline", 3, "text"), ("say", 5, "facts", 2, "lack"), ("nothing", 1, "make", 2, END), ("leave", 2, "text", 3, "person"), ("decline", 3, "make", 4, "text"), ("decline", 2, "this"), ("ask", 2, "decline"), ("decline", 0, END),
    ("not mine", 3, "say"), ("not mine", 3, "make", 4, "text"), ("make", 1, "none", 2, "text"), ("none", 1, "text", 5, "make"), ("none", 2, "attempt", 4, "say"),
    ("rules", 3, "bar", 5, "say"), ("rules", 3, "bar", 5, "talk"), ("rules", 3, "bar", 5, "make", 3, "text"), ("bar", 3, "rules"), ("beyond", 0, "remit"), ("self", 12, "neg"), ("neg", 12, "self"),
    ("text", 12, "facts", 2, "lack"), ("text", 12, "lack", 3, "facts"), ("lack", 4, "facts", 8, "say"), ("lack", 4, "facts", 8, "make", 4, "text"), ("lack", 4, "facts", 5, "text"),
    ("none", 1, "facts", 4, "say"), ("none", 1, "facts", 4, "make", 4, "text"), ("none", 1, "facts", 3, "text"), ("pass", 2, "person"),
)
#: A whole sentence that is one of these.
WHOLE = ("no comment",)

#: Phrases that send the reader elsewhere or are polite, and so say nothing of the matter.
REFERRAL = {
    "please": "please|kindly|veuillez|merci de|bitte|por favor|feel free to",
    "turn": "ask|contact|consult|supply|provide|see|refer|try|speak|check|share|send|let me know|let us know|add|upload|demander|contacter|consulter|fournir|fragen|wenden|liefern|consultar|contactar|facilitar|pregunte",
    "may": "should|may|must|can|could|needs to|might|will need to|devrait|peut|sollte|kann|müsste|debería|puede",
    "look": "look at|look into|be sought|be consulted|be asked|be contacted|review|check|advise|pick this up|pick it up|take this|take it|be obtained|be added|examiner|prüfen|ansehen|revisar",
    "thanks": "thank you|thanks|merci|vielen dank|danke|gracias|sorry|apologies|my apologies|i apologise|i apologize|désolé|leider|es tut mir leid|lo siento|unfortunately|malheureusement|lamento",
    "note": "see the note|see note|see the notes|see above|see below|voir la note|siehe hinweis|siehe anmerkung|véase la nota",
}
REFERRAL_RULES = (("please", 1, "turn"), ("may", 3, "look"), ("note",))


class Kinds:
    """Finds phrases of all kinds in one pass (Aho-Corasick), then follows rules over them."""

    def __init__(self, kinds: dict[str, str]):
        self.machine = ahocorasick.Automaton()
        known: dict[str, set[str]] = {}
        for kind, phrases in kinds.items():
            for phrase in phrases.split("|"):
                known.setdefault(" " + " ".join(words(phrase)) + " ", set()).add(kind)
        for phrase, own in known.items():
            self.machine.add_word(phrase, (phrase.count(" ") - 1, own))
        self.machine.make_automaton()

    def marks(self, text_words: list[str]) -> dict[str, list[tuple[int, int]]]:
        """Kind -> (first, behind the last) word of its phrases."""
        text = " " + " ".join(text_words) + " "
        ends = {m.start(): i for i, m in enumerate(re.finditer(" ", text))}
        out: dict[str, list[tuple[int, int]]] = {END: [(len(text_words), len(text_words))]}
        for at, (size, own) in self.machine.iter(text):
            for kind in own:
                out.setdefault(kind, []).append((ends[at] - size, ends[at]))
        return out

    @staticmethod
    def follows(marks: dict[str, list[tuple[int, int]]], rule: tuple[str | int, ...]) -> bool:
        reached = {end for _, end in marks.get(rule[0], ())}
        for gap, kind in zip(rule[1::2], rule[2::2]):
            reached = {end for start, end in marks.get(kind, ()) if any(0 <= start - r <= gap for r in reached)}
            if not reached:
                return False
        return bool(reached)

    def matches(self, text_words: list[str], rules: tuple[tuple[str | int, ...], ...]) -> bool:
        marks = self.marks(text_words)
        return any(rule[0] in marks and self.follows(marks, rule) for rule in rules)


_REFUSAL, _REFERRAL = Kinds(KINDS), Kinds(REFERRAL)
_SENTENCE = re.compile(r"(?<=[.!?;])[\"”’)]*\s+|\n+")


def refuses(sentence_words: list[str]) -> bool:
    """Whether one sentence refuses."""
    marks = _REFUSAL.marks(sentence_words)
    if any((0, len(sentence_words)) in marks.get(kind, ()) for kind in WHOLE):
        return True
    return any(_REFUSAL.follows(marks, rule) for rule in RULES if rule[0] in marks)


def says_nothing(sentence_words: list[str], most: int = 14) -> bool:
    """Whether a short sentence only thanks, excuses or sends elsewhere."""
    if len(sentence_words) > most:
        return False
    marks = _REFERRAL.marks(sentence_words)
    return any(end - start >= len(sentence_words) - 4 or start == 0 and len(sentence_words) <= 6 for start, end in marks.get("thanks", ())) or any(_REFERRAL.follows(marks, rule) for rule in REFERRAL_RULES)


def is_refusal(answer: str, most: int = 12) -> bool:
    """A sentence that refuses, and at most `most` words in sentences that say anything else."""
    refused, rest = 0, 0
    for s in _SENTENCE.split(answer):
        w = words(s) if s else []
        if not w:
            continue
        if refuses(w):
            refused += 1
        elif not says_nothing(w):
            rest += len(w)
    return refused > 0 and rest <= most
