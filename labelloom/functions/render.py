"""Prompt rendering: templates with ``{name}`` slots filled from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.keys import _col
from labelloom.functions.text import tokens

ZERO_SHOT = (
    "Clasifica el correo en una sola de las clases de la lista. "
    "Responde solo con JSON: predicted_label, confidence (0 a 1) y class_scores.\n\n"
    "Clases:\n{labels}\n\nCorreo:\n{text}\n"
)
FEW_SHOT = (
    "Clasifica el último correo en una sola de las clases de la lista. "
    "Responde solo con JSON: predicted_label, confidence (0 a 1) y class_scores.\n\n"
    "Ejemplos:\n{examples}\n\n---\n\nClases:\n{labels}\n\nCorreo:\n{text}\n"
)
CHAT_SYSTEM = "Clasifica el correo en una de estas categorías y responde solo con su nombre.\n\n{labels}"

PLAN_TEMPLATES = [
    "Escribe como {sender_profile} por {channel} en {language}. Motivo: {class_description} ({class_label}). "
    "Tono {tone}, {length_hint} palabras, ruido: {noise_hint}. {secondary_hint} {ambiguity_hint}",
    "PERFIL {sender_profile} | CANAL {channel} | IDIOMA {language} | CASO {class_label}: {class_description}. "
    "TONO {tone} | LONGITUD {length_hint} | RUIDO {noise_hint}. {secondary_hint} {ambiguity_hint}",
    "{sender_profile} cuenta en {language} por {channel} lo ocurrido: {class_description} ({class_label}). "
    "{secondary_hint} {ambiguity_hint} Tono {tone}; extensión {length_hint}; ruido {noise_hint}.",
]


def fill(template: str, slots: dict[str, Column]) -> Column:
    """Concatenate the literal pieces of ``template`` with the slot columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [F.lit(p) if i % 2 == 0 else slots[p] for i, p in enumerate(pieces) if p or i % 2]
    return F.concat(*parts)


def label_block(labels, descriptions: dict[str, str] | None = None) -> str:
    if descriptions:
        return "\n".join(f"- {name}: {descriptions.get(name, '')}" for name in labels)
    return "\n".join(f"- {name}" for name in labels)


def render(text, labels, template: str = ZERO_SHOT, descriptions=None, examples: str = "") -> Column:
    slots = {
        "text": _col(text), "labels": F.lit(label_block(labels, descriptions)), "examples": F.lit(examples),
    }
    return fill(template, slots)


def chat(text, labels, answer=None, system: str = CHAT_SYSTEM) -> Column:
    """Array of {role, content}; with ``answer`` the supervised form."""
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = [turn("system", F.lit(system.replace("{labels}", label_block(labels)))), turn("user", _col(text))]
    if answer is not None:
        turns.append(turn("assistant", _col(answer).cast("string")))
    return F.array(*turns)


def text_budget(labels, budget: int = 1024, system: str = CHAT_SYSTEM) -> int:
    """Blank tokens that a chat example of ``budget`` leaves for its text, after the system turn and the longest label."""
    return max(0, budget - len(system.replace("{labels}", label_block(labels)).split()) - max(len(l.split()) for l in labels))


def sft_example(text, labels, answer, budget: int = 1024, system: str = CHAT_SYSTEM) -> Column:
    """Supervised chat example within ``budget`` blank tokens: (chat, prompt_len).

    Only the text is shortened, so the answer always fits; ``prompt_len`` is the length of the masked part.
    """
    body = F.array_join(F.slice(tokens(_col(text)), 1, text_budget(labels, budget, system)), " ")
    turns = chat(body, labels, answer, system)
    masked = F.length(F.lit(system.replace("{labels}", label_block(labels)))) + F.length(body)
    return F.struct(turns.alias("chat"), masked.cast("bigint").alias("prompt_len"))
