"""Template residue, filler, error pages and script notices in place of text: found line by line, beside boilerplate."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lunario.llm.literals import by_literal
from lunario.session import shared_path

# Evidence patterns, over a cleaned line (see ``clean``) in lower case unless marked otherwise.

#: Characters that are not seen: soft hyphen, zero-width marks, byte order mark.
UNSEEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
#: What a speaker quotes is no evidence.
QUOTED = r"\"[^\"\n]{1,120}\"|«[^»\n]{1,120}»|„[^“”\n]{1,120}[“”]|“[^”\n]{1,120}”"

#: Unfilled fields; letter case counts. A field of a page template has a name or an instruction between its marks.
FIELDS = (
    r"\{\{\{? ?[\w.]+ ?\}?\}\}", r"\$\{ ?[\w.]+ ?\}", r"<%=? ?[\w.]+ ?%>", r"\{% ?[\w.]+ ?%\}", r"#\{ ?[\w.]+ ?\}", r"\[\[ ?[\w.]+ ?\]\]",
    r"<<? ?[a-z]+[_.][\w.]+ ?>>?", r"<<\w+>>", r"&lt; ?[\w.]+ ?&gt;", r"\{[a-zà-ÿ]+(?:[_.][\w.]+)?\}", r"%[A-ZÀ-Þ]+(?:_[A-ZÀ-Þ]+){0,8}%", r"\$[A-ZÀ-Þ]+(?:_[A-ZÀ-Þ]+){0,8}\$",
    r"@@[A-ZÀ-Þ_]+@@", r"__[A-ZÀ-Þ]+(?:_[A-ZÀ-Þ]+){0,8}__", r"\[[A-ZÀ-Þ]{2,40}(?:_[A-ZÀ-Þ]+){1,8}\]", r"\[object Object\]",
    r"(?i)[\[(<][^\])>\n]{0,30}\b(?:insert(?:ed|ar|e)?|inserire|ins[ée]rer|einf[üu]gen|einsetzen|einzuf[üu]gen|einzusetzen|eintragen|enter|placeholder|segnaposto|platzhalter|to be (?:added|completed|confirmed))\b[^\])>\n]{0,40}[\])>]",
    r"\[[A-ZÀ-Þ]{4,40}(?: [A-ZÀ-Þ]+){0,8}\]",
    r"(?i)\[(?:party|member|speaker|item|group|date|sitting|chamber|gruppo|oratore|data|nome|nom|groupe|orateur|name|fraktion|redner|datum|grupo|orador|nombre|fecha)(?: (?:name|title|number|text|date|of \w+|del? \w+|der \w+|du \w+))?\]",
)
#: What a template prints for a missing value, where a name or a text should be.
MISSING = r"\bundefined\b(?<!\b(?:is|are|was|were|be|been|remains?|left|an?|so|still|too|largely)\sundefined)|(?::|\bof|\bat|\bin|\bby|\bdi|\bde|\bvon|\bà|\ba)\s+(?:null|nan|none)\b(?=\s*(?:[.,;)]|$))"

#: A line without these is no Latin filler.
LATIN_SIGN = r"\b(?:lorem|ipsum|amet|consectetur|adipiscing|eiusmod|incididunt|aliqua|veniam|nostrud|ullamco|laboris|nisi|irure|cillum|fugiat|pariatur|excepteur|sint|occaecat|cupidatat|proident|mollit)\b"
#: Where a sentence starts.
_START = r"(?:^|[.!?…:;|]\s+|>\s*|^\W+|[–-]\s+)"
#: Words of the usual Latin filler; three or more of them fill a line in which nothing else is said.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
)
FILLER = (
    r"\blorem ipsum dolor\b", r"\blorem text\b", r"\b(?:this is|here is|dies ist|das ist|questo è|ceci est|este es|esto es)(?: an?| un| ein)? (?:(?:placeholder|sample|dummy|filler) (?:text|copy|speech|paragraph)|(?:blind|platzhalter|muster)text|testo (?:segnaposto|di prova|di riempimento)|faux[- ]texte|texte (?:de remplissage|d'essai|provisoire|factice)|texto (?:de relleno|de prueba|de ejemplo|provisional))\b",
    _START + r"(?:(?:placeholder|sample|dummy|filler) (?:text|copy|speech|paragraph)|(?:blind|platzhalter|muster)text|testo (?:segnaposto|di prova|di riempimento)|faux[- ]texte|texte (?:de remplissage|d'essai|provisoire|factice)|texto (?:de relleno|de prueba|de ejemplo|provisional))\b",
    r"\b(?:this|the) text (?:is only here|only shows|will be replaced|is to be replaced)\b|\breplace (?:this (?:text|paragraph)|before (?:release|publication|publishing))\b",
    _START + r"(?:(?:your|the) )?(?:text|content|speech|copy) (?:goes |comes |to come |will appear )?here\b|\binsert (?:your |the )?(?:\w+ )?(?:text|content|speech) here\b|\b(?:text|content|speech) (?:of the speech )?to (?:come|follow)\b\W*$",
    _START + r"(?:inserire|inserisci|scrivere) qui\b|" + _START + r"(?:ins[ée]re[rz]|écri(?:re|vez)) ici\b|" + _START + r"(?:votre|le) texte (?:vient |va |viendra )?ici\b|" + _START + r"(?:il tuo |il vostro |il )?testo (?:va |andrà )?qui\b",
    _START + r"(?:inserte|insertar|escriba|escribir) aquí\b|" + _START + r"(?:su |el )?(?:texto|contenido) (?:va |irá )?aquí\b|" + _START + r"hier (?:steht|kommt|folgt|erscheint) (?:später )?(?:die|der|ihr|ihre) (?:rede|text|inhalt)\b|" + _START + r"(?:ihr |hier )?(?:text|inhalt) (?:hier|hier einfügen|einfügen)\b",
    _START + r"(?:qui|ici|aquí|here) (?:(?:più tardi|plus tard|más tarde|later) )?(?:comparirà|andrà|figurera|viendra|irá|aparecerá|will be|goes|comes) (?:\w+ )?(?:il testo|l'intervento|le texte|l'intervention|el texto|el discurso|la intervención|the text|the speech)\b",
    _START + r"(\w{3,12})(?:[\s,.…-]{1,3}\1\b){3}", r"\b(test|prova|essai|prueba|probe|testo|texte|texto|text|asdf|jkl|qwerty|bla|blah|xxx+)(?:[\s,.]{1,3}\1\b){2}", r"\basdf(?:asdf|ghjk)|\basdf asdf\b|\bqwertyuiop\b",
)

_THING_EN = r"(?:page|record|transcript|document|file|resource|url|address|link|item|report|content|debate|sitting|speech|entry|archive|service|site|server|session)"
_THING_IT = r"(?:pagina|resoconto|documento|file|risorsa|indirizzo|contenuto|verbale|seduta|archivio|servizio|sito|server|sessione|scheda)"
_THING_FR = r"(?:page|compte rendu|document|fichier|ressource|adresse|contenu|débat|archive|service|site|serveur|session|fiche|enregistrement)"
_THING_DE = r"(?:seite|protokoll|dokument|datei|ressource|adresse|inhalt|eintrag|archiv|dienst|server|sitzung|bericht|datensatz)"
_THING_ES = r"(?:página|pagina|acta|documento|archivo|fichero|recurso|dirección|contenido|registro|servicio|sitio|servidor|sesión|ficha)"
_GAP = r"(?:\s+[^\s.!?]+){0,7}?\s+"
_SORRY = r"(?:sorry|oops|ops|we are sorry|we're sorry|attention|notice|warning|hoppla|achtung|hinweis|entschuldigung|leider|spiacenti|attenzione|avviso|siamo spiacenti|désolés?|oups|attention|avis|nous sommes désolés|lo sentimos|atención|aviso|vaya|ups|uy)[,!:]*"
ERRORS = (
    rf"{_START}(?:http )?(?:error|errore|erreur|fehler)(?: http| code| codice| nr\.?| n°)?[ :#]*[1-5]\d\d\b",
    r"\b[45]\d\d\b\W{1,4}(?:not found|forbidden|bad |internal|service |gateway|unauthori[sz]ed|gone\b|too many|access|pagina non|page (?:non|introuv)|seite nicht|página no|accesso|accès|zugriff|acceso|servizio|dienst|servicio|errore|erreur|fehler|error)",
    r"^\W*(?:http[ /]?)?[45]\d\d\W*(?:[a-zà-ÿ]+\W+){1,4}$(?<=(?:found|forbidden|gateway|error|unavailable|timeout|time-out|gone|trovata|introuvable|gefunden|encontrada|denied)\W{0,3})",
    r"\b(?:internal server error|errore interno del server|erreur interne du serveur|error interno del servidor|interner serverfehler)\b",
    r"\bbad gateway\b|\bgateway time-?out\b|\bservice (?:is )?(?:temporarily )?unavailable\b|\bupstream (?:request )?(?:timeout|timed out|connect)|\bconnection (?:to \w+ )?(?:refused|reset|timed out)\b|\bedge gateway\b",
    r"\bservizio (?:\w+mente )?non disponibile\b|\bservice (?:\w+ment )?indisponible\b|\bdienst (?:ist )?(?:vorübergehend|derzeit|zurzeit) nicht (?:verfügbar|erreichbar)\b|\bservicio (?:\w+mente )?no disponible\b",
    r"^\W*(?:too many requests|troppe richieste|trop de (?:requêtes|demandes)|zu viele anfragen|demasiadas (?:solicitudes|peticiones)|sessione scaduta|session expir(?:ed|ée)|sitzung abgelaufen|sesión caducada)\b",
    r"^\W*(?:uncaught |fatal |unhandled )?\w*(?:exception|reference|error) (?:at|in) \w+\.\w+|^\W*at \w+(?:\.\w+){1,20}(?:\(|$)|\btraceback \(most recent\b|\bfailed to open stream\b|\bno such file\b|^\W*(?:warning|notice|fatal error): \w+\(|\bquery failed\b|\brelation \S+ does not exist\b|\b(?:fetch|request|load) (?:aborted|failed|timed out) after\b|\bsyntax error (?:at|near)\b|\bstack trace\b\W|\bsegmentation fault\b|\bcannot read propert",
    rf"{_START}(?:access denied|accesso negato|accès refusé|zugriff verweigert|acceso denegado|forbidden)\b",
    r"\b(?:you do not|you don't) have permission to (?:view|access|see|open)\b|\bnon (?:avete|hai|dispone|si dispone)[^.]{0,20}(?:permess|autorizzazion)[^.]{0,40}(?:risorsa|pagina|server)|\bvous n'avez pas (?:la permission|l'autorisation|le droit)[^.]{0,40}(?:ressource|page|serveur)|\bkeine berechtigung[^.]{0,50}(?:ressource|seite|server)|\bno tiene permiso[^.]{0,40}(?:recurso|página|servidor)",
    rf"{_START}(?:{_SORRY} )?(?:the|this|your|a) (?:requested )?{_THING_EN}\b(?:{_GAP}|\s+)(?:could not be|cannot be|can't be|was not|not|failed to|has expired|have expired|does not exist|doesn't exist|is no longer|no longer|requires? (?:you )?to (?:sign|log)|is being (?:rebuilt|moved|updated)|is (?:temporarily |currently )?(?:unavailable|under maintenance|missing|gone)|may have been (?:moved|deleted|removed)|was unable to complete|did not (?:respond|answer)|timed out|took too long)\b[^.!?]{{0,60}}(?:$|[.!?…])",
    rf"{_START}{_THING_EN} (?:not found|expired|unavailable|missing|timed out|cannot be displayed)\b",
    rf"\bthe page may have been moved|\bthe server was unable to complete your request|\byour session (?:has )?expired|\btry again in \S+ (?:minutes|seconds)\b|\brequest id\b\W|{_START}reference\W+[0-9a-f-]{{3,}}\W*$|\btell the administrator and quote\b|\bcause: connection\b|\ban unexpected error\b|\bsomething went wrong\b|\bplease (?:sign|log) in to (?:view|read|continue)\b",
    rf"{_START}(?:{_SORRY} )?(?:il|la|lo|l'|questo|questa)\s?{_THING_IT}\b(?:{_GAP}|\s+)(?:non (?:è stat[oa] trovat[oa]|si può mostrare|può mostrarsi|è disponibile(?! +(?:desde|dal|dalla|depuis|seit|since)\b)|esiste|si trova|può essere|ha risposto|è raggiungibile)|è scadut[oa]|richiede (?:l'accesso|di accedere)|è in (?:manutenzione|ricostruzione)|è stat[oa] (?:spostat[oa]|rimoss[oa]|eliminat[oa])|non si è caricat[oa])\b",
    rf"\bpagina non trovata\b|\bla pagina che cercate\b|\bsi è verificato un errore\b|\briprovare tra \S+ (?:minuti|secondi)\b|\bcodice (?:di )?richiesta\b\W|\bcontattare l'amministratore del sito\b|\bla (?:vostra |sua )?sessione è scaduta\b|\bil server non ha risposto\b|\bverificare l'indirizzo\b|{_START}causa: conness",
    rf"{_START}(?:{_SORRY} )?(?:le|la|l'|cette|ce|votre)\s?{_THING_FR}\b(?:{_GAP}|\s+)(?:n'a pas (?:été trouvée?|pu être|répondu|pu se)|est introuvable|n'existe pas|n'existe plus|ne peut (?:pas )?être|ne peut s'afficher|a expiré|exige une (?:connexion|identification)|requiert une|est en (?:cours de|maintenance)|a (?:peut-être )?été (?:déplacée?|supprimée?)|n'est pas disponible(?! +(?:desde|dal|dalla|depuis|seit|since)\b))",
    rf"\bpage (?:introuvable|non trouvée)\b|\bune erreur (?:inattendue|est survenue|s'est produite)|\bréessayez dans \S+ (?:minutes|secondes)\b|\bveuillez réessayer dans\b|\b(?:numéro|code|identifiant|référence) de (?:la )?(?:requête|demande)\b\W|\bcontactez l'administrateur|\bvotre session a expiré\b|\ble serveur n'a pas (?:répondu|pu)\b|\bvérifiez l'adresse\b|{_START}cause : connexion",
    rf"{_START}(?:{_SORRY} )?(?:die|das|der|diese[rs]?|ihre?)\s{_THING_DE}\b(?:{_GAP}|\s+)(?:wurde nicht gefunden|nicht gefunden|gibt es nicht|existiert nicht|konnte nicht|kann nicht (?:angezeigt|geladen|gefunden)|ist abgelaufen|verlangt eine anmeldung|erfordert eine anmeldung|wird (?:neu aufgebaut|gerade)|wurde (?:verschoben|gelöscht|entfernt)|ist (?:nicht (?:verfügbar|erreichbar)(?! +(?:desde|dal|dalla|depuis|seit|since)\b)|in wartung)|lässt sich nicht (?:anzeigen|laden|öffnen)|hat nicht (?:rechtzeitig )?geantwortet|ließ sich nicht)",
    rf"\bseite nicht gefunden\b|\bein unerwarteter fehler\b|\bversuchen sie es in \S+ (?:minuten|sekunden) erneut\b|\b(?:vorgangs|anfrage|referenz)(?:nummer|kennung|code|-id)\W+[0-9a-f-]+|\bwenden sie sich an (?:den administrator|die verwaltung der website)|\bihre sitzung ist abgelaufen\b|\bder server (?:hat nicht|konnte)\b|\bprüfen sie die adresse\b|{_START}ursache: verbindung",
    rf"{_START}(?:{_SORRY} )?(?:el|la|este|esta|su)\s{_THING_ES}\b(?:{_GAP}|\s+)(?:no (?:se encuentra|se ha encontrado|existe|está disponible(?! +(?:desde|dal|dalla|depuis|seit|since)\b)|se puede (?:mostrar|cargar)|puede (?:mostrarse|cargarse|encontrarse)|pudo|respondió|ha respondido)|ha caducado|(?:exige|requiere) (?:iniciar sesión|una conexión|identificarse)|está en (?:mantenimiento|reconstrucción)|se (?:está reconstruyendo|ha movido|ha eliminado)|ha sido (?:movid[oa]|eliminad[oa]))",
    rf"\bpágina no encontrada\b|\berror inesperado\b|\b(?:vuelva a intentarlo|inténtelo de nuevo|reintente) en \S+ (?:minutos|segundos)\b|\b(?:código|número|identificador|referencia) de (?:la )?solicitud\b\W|\bcontacte con el administrador|\bsu sesión ha caducado\b|\bel servidor no (?:respondió|ha podido|pudo)\b|\bcompruebe la dirección\b|{_START}causa: conexión",
)
#: A record of a service in place of a text; quotes belong to it.
JSON_ERROR = r"(?i)\{\s*\"(?:status|error|code|message)\"\s*:"

_SCRIPT = r"(?:java ?script|js\b|scripts?\b|scripting|skripte?\b|script(?:s)? actifs?)"
SCRIPTS = (
    rf"\b(?:enable|activate|allow|unblock|turn on|switch on|permit) (?:active )?{_SCRIPT}",
    rf"\b(?:abilitare|attivare|consentire|sbloccare|permettere|autorizzare|abilitate|attivate|consentite|abiliti|attivi|sbloccate) (?:gli |l'esecuzione (?:di|degli) |il )?{_SCRIPT}",
    rf"\b(?:activer|autoriser|débloquer|permettre|activez|autorisez|débloquez) (?:les |l'exécution (?:de|des) |le )?{_SCRIPT}",
    rf"\b(?:habilitar|activar|permitir|desbloquear|active|habilite|permita|desbloquee) (?:los |la ejecución de |el )?{_SCRIPT}",
    rf"\b(?:aktivieren|erlauben|zulassen|freigeben|einschalten) (?:sie )?(?:bitte )?{_SCRIPT}|\b{_SCRIPT}[^.!?]{{0,40}}\b(?:aktivieren|erlauben|zulassen|freigeben|einschalten|freischalten|entsperren)\b",
    rf"\b(?:site|page|app|application|reader|viewer|transcript|applicazione|sito|pagina|lettore|application|cette page|anwendung|seite|aplicación|sitio|página|visor) (?:requires?|needs?|works only with|richiede|necessita|nécessite|requiert|exige|benötigt|erfordert|requiere|necesita) {_SCRIPT}",
    rf"\b{_SCRIPT} (?:seems? to be|appears? to be|is|are|risultano|sembra(?:no)?|è|sono|semble(?:nt)?|est|sont|ist|sind|scheinen?|parecen?|está(?:n)?) (?:essere |être |estar )?(?:disabled|switched off|turned off|blocked|off\b|disattivat[oi]|disabilitat[oi]|bloccat[oi]|désactivés?|bloqués?|deaktiviert|ausgeschaltet|blockiert|desactivados?|deshabilitados?|bloqueados?)",
    rf"\b(?:browser|navigateur|navegador)\b[^.!?]{{0,40}}\b(?:has them switched off|{_SCRIPT} (?:ausgeschaltet|deaktiviert|désactivés?|desactivados?)|non esegue|n'exécute pas|no ejecuta|(?:blocks|blocca|bloque|blockiert|bloquea) (?:gli |les |los )?{_SCRIPT})",
    r"\b(?:sind|sont|están) (?:die )?(?:skripte|scripts|los scripts) (?:ausgeschaltet|deaktiviert|blockiert|désactivés|bloqués|desactivados|bloqueados)",
    r"\bchecking your browser\b|\bverifica del browser\b|\bvérification de votre navigateur\b|\bihr browser wird geprüft\b|\bcomprobando su navegador\b|^\W*noscript\b",
    rf"\b(?:only|solo|soltanto|seulement|uniquement|nur|sólo) (?:with|con|avec|mit) (?:active )?{_SCRIPT}|\bwithout {_SCRIPT}[^.!?]{{0,30}}(?:cannot|will not|empty|blank)|\bsonst bleibt diese seite leer\b",
    rf"\b{_SCRIPT} (?:is |are )?(?:required|needed|necessar(?:y|io|i)|richiesto|richiesti|obligatoires?|requis|erforderlich|nötig|necesarios?|requeridos?)\b",
)


#: What reads as a sentence: an end mark after a word.
SENTENCE = r"[\p{L}\d]{2}[\"»”’')\]]*(?:[.!?…؟।](?:[\"»”’')\]]*(?:\s|$))|[。！？])"
#: Where a line ends, beside markup tags; where a sentence does.
_TAG = re.compile(r"</?(?:html|head|title|body|h\d|p|div|span|br|a|ul|li|noscript|center|hr)\b[^>]*>")
_BREAK = re.compile(r"[\r\n\u0085\u2028\u2029]+")
_STOP = re.compile(r"(?<=[.!?…])\s+")
_DIGITS = re.compile(r"\d+")
_UNSEEN = re.compile(f"[{UNSEEN}]")
#: A word and, after it, one that begins alike: what a pattern of repeated words is tried on.
_ALIKE = (re.compile(r"\W*(\w{3})\w*[\s,.…-]{1,3}\1").match, re.compile(r"[.!?…:;|>–-]\s*\W*(\w{3})\w*[\s,.…-]{1,3}\1").search)

KINDS = ("campo", "riempitivo", "errore", "script")


class Judge:
    """All patterns, each tried only on sentences that hold one of the literals that every match of it contains.

    The literals are derived from the patterns (:mod:`lunario.llm.literals`) and found in one run of an automaton over
    a line, so the cost of a line without any does not depend on the number of patterns.
    """

    def __init__(self) -> None:
        latin = frozenset(LATIN.split())
        self.tests: list[tuple[int, bool, object]] = []  # kind, in lower case, test
        found: dict[str, set[int]] = {}
        self.always: set[int] = set()
        families = [(0, False, FIELDS), (0, True, (MISSING,)), (1, True, FILLER), (1, True, (LATIN_SIGN,)), (2, False, (JSON_ERROR,)), (2, True, ERRORS), (3, True, SCRIPTS)]
        for kind, low, patterns in families:
            for way, literals in by_literal(patterns):
                test = self._latin(latin) if LATIN_SIGN in patterns else _compiled(way)
                self.tests.append((kind, low, test))
                for x in literals:
                    found.setdefault(x, set()).add(len(self.tests) - 1)
                if not literals:
                    self.always.add(len(self.tests) - 1)
        self.automaton = ahocorasick.Automaton()
        for x, tests in found.items():
            self.automaton.add_word(x, tests)
        self.automaton.make_automaton()
        self.json, self.quoted, self.speech = re.compile(JSON_ERROR).search, re.compile(QUOTED), regex.compile(SENTENCE).search

    @staticmethod
    def _latin(known: frozenset[str]):
        def test(low: str) -> bool:
            words = re.findall(r"[a-zà-ÿ]+", low)
            own = [w for w in words if w in known]
            return len(set(own)) >= 3 and len(own) * 10 >= len(words) * 8

        return test

    def clean(self, line: str) -> str:
        """A line without unseen characters, its blanks single."""
        return " ".join((_UNSEEN.sub("", line) if not line.isascii() else line).split())

    def kinds(self, line: str) -> list[str]:
        """The kind of evidence of each sentence of a cleaned line that has any; what is quoted has none."""
        said = self.quoted.sub(" ", line) if any(q in line for q in '"«„“') and not self.json(line) else line
        low = said.lower()
        if len(low) != len(said):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in said)
        hits = list(self.automaton.iter(low))
        alike = _ALIKE[0](low) or _ALIKE[1](low)
        if not hits and not alike:
            return []
        stops = [m.span() for m in _STOP.finditer(low)]
        begins = [0, *(b for _, b in stops)]
        ends = [*(a for a, _ in stops), len(low)]
        tried: dict[int, set[int]] = {}
        for at, tests in hits:
            k = bisect_right(begins, at) - 1
            tried.setdefault(k, set()).update(tests)
        if alike:
            for k in range(len(begins)):
                tried.setdefault(k, set()).update(self.always)
        out = []
        for k in sorted(tried):
            sentence, lower = said[begins[k] : ends[k]], low[begins[k] : ends[k]]
            for kind, test in sorted((self.tests[t][0], t) for t in tried[k]):
                if self.tests[test][2](lower if self.tests[test][1] else sentence):
                    out.append(KINDS[kind])
                    break
        return out

    def lines(self, text: str) -> list[tuple[int, list[str], str]]:
        """(hash by which a line is counted, kinds of its evidence, the line) of each line that is not blank.

        Lines with evidence are counted in lower case with runs of digits as one 0; all others as written, in lower
        case, as two speeches may differ in a number only.
        """
        out = []
        for raw in _BREAK.split(_TAG.sub("\n", text) if "<" in text else text):
            line = self.clean(raw)
            if line:
                kinds = self.kinds(line)
                form = _DIGITS.sub("0", line.lower()) if kinds else line.lower()
                out.append((xxhash.xxh64_intdigest(form.encode("utf-8", "surrogatepass"), 1 if kinds else 0) - 2**63, kinds, line))
        return out


def _compiled(pattern: str):
    try:
        return re.compile(pattern).search
    except re.error:  # a condition on what stands before, of no fixed length
        return regex.compile(pattern).search


@functools.cache
def judge() -> Judge:
    """The patterns, compiled once in a process."""
    return Judge()


def evidence(sentence: str) -> str | None:
    """The kind of evidence in a sentence, or none: ``campo``, ``riempitivo``, ``errore``, ``script``."""
    j = judge()
    return next(iter(j.kinds(j.clean(sentence))), None)


LINES = pa.list_(pa.struct([("h", pa.int64()), ("kinds", pa.list_(pa.string())), ("speech", pa.bool_())]))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, host, text) -> (doc, host, hash of the text, hashes of its lines, its lines if any holds evidence)."""
    j = judge()
    for b in batches:
        rows, hashes, lines = [], [], []
        for text in b.column(2).to_pylist():
            found = j.lines(text)
            rows.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63)
            hashes.append(list({h for h, _, _ in found}))
            held = any(kinds for _, kinds, _ in found)
            lines.append([{"h": h, "kinds": kinds, "speech": not kinds and j.speech(line) is not None} for h, kinds, line in found] if held else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(lines, LINES)], ["_doc", "_host", "_row", "_hashes", "_lines"])


def residue(documents: DataFrame, *, doc: str, text: str, host: str, least_share: float = 0.05) -> DataFrame:
    """One row per document with residue: its id, the kinds found (sorted) and the number of sentences with evidence.

    Lines are counted by host, once a document; those with evidence without regard to digits, all others as written. Lines that stand in at least
    ``least_share`` of the host's documents recur, whatever the host's size; a line of one document alone does not. Beside a real speech they are boilerplate of the host's pages
    (headings, menus, footers) and their evidence does not count. In a document without any other line that reads as
    speech, nothing was said that they could belong to: there all evidence counts, so an error page or notice is
    named however many copies the host holds. What a speaker quotes is no evidence. Null, empty and blank texts hold
    none. Documents of the null host form a host. Every document with residue is named, repeats too; rows that share
    an id give one row.

    Scale: the texts are read once, row by row; hashes of lines, and the marks of those of documents with evidence,
    are written to the shared folder and counted there, before the shuffle. A host has at most (lines a document) /
    ``least_share`` recurrent lines. Only the lines of documents with evidence meet them, so neither a host with a
    third of all documents nor a line that all its pages share is gathered in one task.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc).alias("_doc"), F.col(host).alias("_host"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    judged = rows.mapInArrow(_judged, f"{kinds}, _row bigint, _hashes array<bigint>, _lines array<struct<h:bigint,kinds:array<string>,speech:boolean>>")
    judged.write.parquet(kept := shared_path(spark, "p9-righe"))
    judged = spark.read.parquet(kept)
    counted = judged.select("_host", F.explode("_hashes").alias("_h")).groupBy("_host", "_h").agg(F.count("*").alias("_in")).where("_in > 1")
    sizes = judged.groupBy(F.col("_host").alias("_host2")).agg(F.count("*").alias("_docs"))
    recurrent = counted.join(sizes, F.col("_host").eqNullSafe(F.col("_host2"))).where(F.col("_in") >= F.col("_docs") * least_share).select(F.col("_host").alias("_bhost"), "_h")
    seen = judged.where("_lines is not null").select("_doc", "_host", "_row", F.inline("_lines"))
    met = seen.join(recurrent, F.col("_host").eqNullSafe(F.col("_bhost")) & (F.col("h") == F.col("_h")), "left")
    own, again = F.when(F.col("_h").isNull(), F.col("kinds")), F.when(F.col("_h").isNotNull(), F.col("kinds"))
    left = met.groupBy("_doc", "_host", "_row").agg(
        F.flatten(F.collect_list(own)).alias("_own"), F.flatten(F.collect_list(again)).alias("_again"), F.bool_or(F.col("speech") & F.col("_h").isNull()).alias("_said")
    )
    left = left.select("_doc", F.explode(F.when(F.col("_said"), F.col("_own")).otherwise(F.concat("_own", "_again"))).alias("_kind"))
    return left.groupBy("_doc").agg(F.array_sort(F.collect_set("_kind")).alias("tipi"), F.count("*").alias("n_frasi")).withColumnRenamed("_doc", doc)
