"""The claim router: which part of a booklet a claim's opening names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import opening

#: Fixed values: (part, pattern that the opening begins with), in the order of precedence.
RULES: tuple[tuple[str, str], ...] = (
    ("summary", r"[^,.;:]{0,40}\b(laut|gemäss|gemäß) (der )?zusammenfassung\b"),
    ("summary", r"[^.;:]{0,40}\b(selon|d'après) le résumé\b"),
    ("summary", r"[^.;:]{0,40}\b(secondo il|stando al|nel) (riassunto|riepilogo)\b"),
    ("summary", r"(nach der zusammenfassung|wie die zusammenfassung|laut (der )?kurzfassung|in kürze\b)"),
    ("summary", r"(selon la synthèse|en bref\b|comme l'indique le résumé)"),
    ("summary", r"(in breve\b|in sintesi\b|secondo la sintesi|dal riassunto|come indica il riassunto)"),
    ("council", r"(bundesrat und parlament|nach (ansicht|meinung|auffassung) (des bundesrat(e)?s|von bundesrat)|aus sicht des bundesrat(e)?s|für den bundesrat|gemäß (dem )?bundesrat)\b"),
    ("council", r"(conseil fédéral et (le )?parlement|pour le conseil fédéral|de l'avis du conseil fédéral|aux yeux du conseil fédéral|selon l'avis du conseil fédéral)\b"),
    ("council", r"(consiglio federale e (il )?parlamento|secondo consiglio federale|a parere del consiglio federale|ad avviso del consiglio federale|stando al consiglio federale|secondo il parere del consiglio federale)\b"),
    ("committee", r"(die (initiativ|referendums)komitees|das [\w-]+ komitee|das initiativ-komitee|gemäss (dem )?komitee|dem komitee zufolge|nach ansicht des (initiativ|referendums)?komitees|aus sicht des (initiativ|referendums)?komitees|die initiant(inn)?en)\b"),
    ("committee", r"(les comités|pour le comité|de l'avis du comité|les initiants|les auteurs de l'initiative)\b"),
    ("committee", r"(i comitati|stando al comitato|a detta del comitato|a parere del comitato|i promotori|secondo i promotori)\b"),
    ("law", r"(nach dem abstimmungstext|laut (dem )?(initiativtext|gesetzestext|verfassungstext)|gemäss (dem )?(initiativtext|gesetzestext|verfassungstext))\b"),
    ("law", r"((selon|d'après) le texte (de l'initiative|de loi|mis aux voix)|aux termes du texte soumis au vote|le texte de loi)\b"),
    ("law", r"(secondo il testo (dell'iniziativa|della legge|di legge)|il testo di legge)\b"),
    ("detail", r"(wird die (initiative|gesetzesänderung)|wird das gesetz|wird der bundesbeschluss) angenommen\b"),
    ("detail", r"(bei annahme der initiative|wenn die initiative angenommen|falls die (vorlage|initiative) angenommen|sollte die (vorlage|initiative) angenommen|bei einem ja\b|mit der annahme der (vorlage|initiative)|nimmt das volk die (vorlage|initiative) an)"),
    ("detail", r"(si (l'initiative|la loi|la modification|la révision|le projet de loi|l'arrêté fédéral) (est|sera) (accepté|approuvé|adopté)|en cas d'acceptation\b|en cas de oui\b|si le peuple accepte)"),
    ("detail", r"(se (l'iniziativa|la legge|la modifica|il decreto federale) (viene|verrà|sarà|è) (accettat|approvat|accolt)|in caso di (approvazione|accettazione|sì)\b|se il popolo approva|qualora il progetto|con l'accettazione)"),
    ("summary", r"(laut|gemäss|gemäß) (der )?zusammenfassung\b"),
    ("summary", r"(der zusammenfassung zufolge|die zusammenfassung|in der zusammenfassung)\b"),
    ("summary", r"(le résumé|selon le résumé|d'après le résumé|dans le résumé)\b"),
    ("summary", r"(il riassunto|nel riassunto|secondo il riassunto|stando al riassunto|il riepilogo|nel riepilogo|secondo il riepilogo)\b"),
    ("law", r"(laut|gemäss|gemäß) (dem )?abstimmungstext\b"),
    ("law", r"(dem abstimmungstext zufolge|der abstimmungstext|im abstimmungstext)\b"),
    ("law", r"(selon|d'après) le texte (soumis au vote|soumis à la votation|de (la )?vot(e|ation))\b"),
    ("law", r"le texte (soumis au vote|de (la )?vot(e|ation))\b"),
    ("law", r"(stando al|secondo il|in base al|nel) testo (di voto|sottoposto|della votazione|in votazione)\b"),
    ("law", r"il testo (di voto|sottoposto|della votazione|in votazione)\b"),
    ("council", r"(der bundesrat|laut (dem )?bundesrat|gemäss (dem )?bundesrat|dem bundesrat zufolge)\b"),
    ("council", r"(le conseil fédéral|selon le conseil fédéral|d'après le conseil fédéral)\b"),
    ("council", r"(il consiglio federale|secondo il consiglio federale|per il consiglio federale)\b"),
    ("committee", r"(das (initiativ|referendums)?komitee|laut (dem )?(initiativ|referendums)?komitee)\b"),
    ("committee", r"(le comité|selon le comité|d'après le comité)\b"),
    ("committee", r"(il comitato|secondo il comitato|per il comitato)\b"),
    ("detail", r"(wird die (abstimmung|vorlage) angenommen|bei annahme der (abstimmung|vorlage)|wenn die (abstimmung|vorlage) angenommen)\b"),
    ("detail", r"si (le vote|la votation|l'objet|le projet|cette proposition|la proposition|la motion) (est|sera) (accepté|approuvé|adopté)"),
    ("detail", r"l'(adoption|acceptation) (du vote|de la votation|de l'objet|du projet)\b"),
    ("detail", r"se (il voto|la votazione|la proposta|il progetto) (viene|verrà|sarà|riceverà|è)\b"),
)


def first_match(text: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The part of the first rule whose pattern `text` begins with; null for none."""
    out = None
    for part, pattern in rules:
        hit = text.rlike(f"(?U)^(?:{pattern})")
        out = F.when(hit, part) if out is None else out.when(hit, part)
    return out


def route(claims: DataFrame, text: str = "text") -> DataFrame:
    return claims.withColumn("part", first_match(opening(F.col(text))))
