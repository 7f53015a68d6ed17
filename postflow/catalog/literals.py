"""What the SQL counterparts expect, written out apart from the engine, so that a slip in one shows."""

from __future__ import annotations

# --- Fixed values: patterns, marks, synonyms and limits ----------------------
UMLAUTS = {'ä': 'ae', 'ö': 'oe', 'ü': 'ue', 'ß': 'ss', 'Ä': 'ae', 'Ö': 'oe', 'Ü': 'ue'}
HOURLY_LABELLED = '(?:stundensatz|hourly rate|stundenlohn)\\D{0,10}(\\d+(?:[.,]\\d+)?)'
HOURLY_UNIT = '(\\d+(?:[.,]\\d+)?)\\s*(?:€|EUR|eur)?\\s*/?\\s*(?:std\\.?|stunde|h\\b|hour)'
DAILY_LABELLED = '(?:tagessatz|daily rate|rate)\\D{0,10}(\\d+(?:[.,]\\d+)?)'
DAILY_UNIT = '(\\d+(?:[.,]\\d+)?)\\s*(?:€|EUR|eur)?\\s*/?\\s*(?:tag|day|pt\\b|pd\\b|pro tag|per day)'
WORK_MODES = {'remote': 'remote',
 '100% remote': 'remote',
 'vollständig remote': 'remote',
 'home office': 'remote',
 'homeoffice': 'remote',
 'voll remote': 'remote',
 'fully remote': 'remote',
 'hybrid': 'hybrid',
 'teilweise vor ort': 'hybrid',
 'partially onsite': 'hybrid',
 'hybrid (remote / vor ort)': 'hybrid',
 'remote/hybrid': 'hybrid',
 'vor ort': 'onsite',
 'onsite': 'onsite',
 'on-site': 'onsite',
 'präsenz': 'onsite',
 'in house': 'onsite'}
CONTRACT_TYPES = {'freelance': 'freelance',
 'freiberuflich': 'freelance',
 'selbständig': 'freelance',
 'projektbasis': 'freelance',
 'projekt': 'freelance',
 'anü': 'anue',
 'arbeitnehmerüberlassung': 'anue',
 'zeitarbeit': 'anue',
 'leiharbeit': 'anue',
 'arbeitnehmerüberlassung (anü)': 'anue',
 'festanstellung': 'permanent',
 'fest': 'permanent',
 'vollzeit': 'permanent',
 'vollzeitstelle': 'permanent',
 'unbefristet': 'permanent',
 'angestelltenverhältnis': 'permanent',
 'full-time employee': 'permanent',
 'fte': 'permanent'}
NEGATION = '\\b(kein(?:e|en|em|er|es)?|nicht|no\\s|without|ohne|ausgeschlossen|nicht\\s+vorgesehen|nicht\\s+möglich)\\s+'
LANGUAGES = {'de': '\\b(deutsch|german|de\\b|auf '
       'deutsch|deutschkenntnisse|deutschsprachig|german\\s+language|sprache:\\s*deutsch)',
 'en': '\\b(english|englisch|en\\b|englischkenntnisse|englischsprachig|english\\s+language|sprache:\\s*englisch)',
 'nl': '\\b(dutch|niederländisch|nl\\b|vlaams|dutch\\s+language|sprache:\\s*niederländisch)'}
WORD = '0-9a-zäöüß'
GAP = '(?U:[\\s\\x1c-\\x1f\\-]*)'
MUST_START = '(?:^|\\n|\\*\\*)[ \\t]*(?:ihr |dein |deine )?(must[ \\t-]*haves?|muss[ \\t-]*(?:kriterien|anforderungen)|zwingend erforderlich|voraussetzungen|anforderungen|profil|talente|requirements|qualifikation(?:en)?)[ \\t]*(?::|\\*\\*|\\n|$)'
MUST_CHARS = 2500
MUST_END = '(nice[ \\t-]*to[ \\t-]*have|soll[ \\t-]*kriterien|kann[ \\t-]*kriterien|wünschenswert|von vorteil|rahmenparameter|rahmendaten|wir bieten|konditionen)'
HOURS_RANGE = '(\\d{1,2})\\s*(?:-|–|bis)\\s*(\\d{1,2})\\s*(?:Stunden|Std\\.?|h)\\s*(?:pro|/|je|die|per)\\s*Woche'
HOURS = '(\\d{1,2})\\s*(?:Stunden|Std\\.?|h)\\s*(?:pro|/|je|die|per)\\s*Woche'
DAYS = '(\\d)(?:\\s*(?:-|–|bis)\\s*(\\d))?\\s*Tage\\s*(?:pro|/|je|die|per)\\s*Woche'
PERCENT = 'Auslastung\\W{0,8}(\\d{2,3})\\s*%'
FULL_TIME = '\\b(Vollzeit|full[ -]?time)\\b'
PART_TIME = '\\b(Teilzeit|part[ -]?time)\\b'
MONTHS = {'januar': 1,
 'january': 1,
 'februar': 2,
 'february': 2,
 'märz': 3,
 'maerz': 3,
 'march': 3,
 'april': 4,
 'mai': 5,
 'may': 5,
 'juni': 6,
 'june': 6,
 'juli': 7,
 'july': 7,
 'august': 8,
 'september': 9,
 'oktober': 10,
 'october': 10,
 'november': 11,
 'dezember': 12,
 'december': 12}
MONTH_DATE = '(?:(Anfang|Mitte|Ende)\\s+)?(januar|january|februar|february|märz|maerz|march|april|mai|may|juni|june|juli|july|august|september|oktober|october|november|dezember|december)(?:\\s+(\\d{4}))?'
IMMEDIATE = '\\b(asap|ab sofort|sofort|schnellstmöglich|kurzfristig)\\b'
DAY_DATE = '(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})'
START_LABEL = '(Projektzeitraum|Zeitraum|Laufzeit|Projektstart|Einsatzbeginn|Starttermin|Start|Beginn)\\**\\s*:?\\**\\s*([^\\n]{0,80})'
REMOTE_SHARE = '(\\d{1,3})\\s*%\\s*Remote'
EVALUATION_MARK = '## 🤖 AI Evaluation Results'
TRUNCATION_MARK = '\n\n[... TEXT GEKÜRZT — KÜRZUNG KENNZEICHNET FEHLENDE INFORMATION ...]\n\n'
TRUNCATION_NOTE = '\n\nHINWEIS: Der Projekttext wurde aus Kapazitätsgründen gekürzt. Bewerte nur auf Basis der vorhandenen Informationen. Falls wesentliche Anforderungen fehlen, gib score=0 und erkläre dies im rationale-Feld. Erzeuge keine Scheingenauigkeit.'
IBAN = '\\b[A-Z]{2}\\d{2}[\\s]?[0-9A-Z]{4}[\\s]?[0-9]{4}[\\s]?[0-9]{4}(?:[\\s]?[0-9]{0,4}){0,4}\\b'
EMAIL = '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b'
PHONE = '(?:\\+?\\d{1,3}[\\s\\-.]?\\(?\\d{2,5}\\)?[\\s\\-.]?\\d{2,5}[\\s\\-.]?\\d{2,5}|0\\d{2,5}[\\s\\/\\-]?\\d{3,8})'
NAME = '\\b(?:Herr|Frau|Hr\\.|Fr\\.|Mr\\.|Mrs\\.|Ms\\.)\\s+[A-ZÄÖÜ][a-zäöüß\\-]+(?:\\s+[A-ZÄÖÜ][a-zäöüß\\-]+)?'
KINDS = ['thread', 'signature', 'iban', 'email', 'contact_label', 'phone', 'name']
PLACEHOLDER = '\\[(?:EMAIL|PHONE|IBAN|NAME|SCRUBBED)\\]'
IBAN_LEFT = '\\b[A-Z]{2}\\d{2}[\\s]?[0-9A-Z]{4}[\\s]?[0-9]{4}[\\s]?[0-9]{4}'
RETENTION = {'logs': 30,
 'temp_files': 7,
 'backups': 365,
 'scraped': 7,
 'rejected_low_pre_eval': 1,
 'rejected_low_llm': 3,
 'rejected_other': 14,
 'accepted': 30,
 'applied': 90,
 'sent': 180,
 'open': 365,
 'archived': 180}
