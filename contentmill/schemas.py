"""Schemas of the stored tables and file formats."""

from __future__ import annotations

from pyspark.sql.types import StructType

PASSAGES = (
    "id long, concurso string, arquivo_origem string, materia string, tema string, ordem int, pagina int, trecho string, hash_conteudo string, created_at timestamp"
)
PASSAGE_FILE = "concurso string, arquivo_origem string, materia string, tema string, ordem int, pagina int, trecho string, hash_conteudo string"
QUESTIONS = (
    "id long, concurso string, materia string, tema string, origem string, formato string, status string, revisado_por string, revisado_em timestamp, motivo_rejeicao string, "
    "texto_auxiliar string, enunciado string, alternativas map<string,string>, gabarito string, comentario string, arquivo_origem string, banca_ano string, "
    "hash_conteudo string, usada_em array<timestamp>, created_at timestamp, updated_at timestamp"
)
QUESTION_FILE = (
    "concurso string, materia string, tema string, origem string, formato string, banca_ano string, status string, texto_auxiliar string, "
    "enunciado string, alternativas map<string,string>, gabarito string, comentario string, arquivo_origem string, hash_conteudo string"
)
#: Unique keys.
PASSAGE_KEY = ("concurso", "arquivo_origem", "hash_conteudo")
QUESTION_KEY = ("concurso", "hash_conteudo")
# Enumerations and required columns.
ORIGINS = ("revisao_farol", "mestre_questoes", "atualidades", "simulado_migrado", "banco_real")
STATUSES = ("pendente_revisao", "aprovada", "rejeitada", "publicada")
FORMATS = ("certo_errado", "abcde")
QUESTION_REQUIRED = ("concurso", "materia", "origem", "enunciado", "hash_conteudo")
QUESTION_ALLOWED = {"origem": ORIGINS, "status": STATUSES, "formato": FORMATS}


def columns(ddl: str) -> list[str]:
    """Column names of a flat DDL string."""
    return StructType.fromDDL(ddl).names
