"""Column helpers for ids, names, gapped strings and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def pair_parts(pair_id) -> dict[str, Column]:
    """``PDB_CHAINS1_CHAINS2``; an empty or missing third part means one partner only."""
    parts = F.split(_c(pair_id), "_")
    return {
        "pdb_id": parts[0],
        "chains1": F.nullif(F.get(parts, 1), F.lit("")),
        "chains2": F.nullif(F.get(parts, 2), F.lit("")),
    }


def chain_of_pid(pair_id, pid) -> Column:
    p = pair_parts(pair_id)
    return F.when(_c(pid) == "p1", p["chains1"]).otherwise(p["chains2"])


def atom_key_parts(key) -> dict[str, Column]:
    """``chain_resid_icode_resname_atom_color``; blanks are written '' (chain) and 'x' (icode)."""
    p = F.split(_c(key), "_")
    return {
        "chain": F.when(p[0] == "", F.lit(" ")).otherwise(p[0]),
        "resid": p[1].try_cast("int"),
        "icode": F.when(p[2] == "x", F.lit(" ")).otherwise(p[2]),
        "resname": p[3],
        "atom": p[4],
        "color": F.get(p, 5),
    }


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path, extension: str = ".pdb") -> Column:
    """File name without one trailing extension (a suffix, not a set of characters)."""
    return F.regexp_replace(base_name(path), extension.replace(".", "\\.") + "$", "")


def owner(path: Column | str, ext: str = ".pdb") -> Column:
    """Whose file it is: the value of a ``key=value`` folder that holds it, as the writers lay files out, else the file's name."""
    folder = F.regexp_extract(path, r"/[^/=]+=([^/=]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(stem(path, ext))


def collapse_gaps(s) -> Column:
    return F.regexp_replace(_c(s), "-+", "-")


def strip_gaps(s) -> Column:
    return F.btrim(_c(s), F.lit("-"))


# The twenty standard residues, three-letter name and one-letter code.
RESIDUE_LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def residue_letter(resname) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RESIDUE_LETTERS.items() for x in pair])
    return F.try_element_at(table, _c(resname))


def fixed(v, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", _c(v).cast("double"))


def alignment_score(a, b) -> Column:
    """Best global alignment of two strings: +1 per match, 0 per mismatch, -1 per gap position.

    One row of the dynamic programme is an array; each letter of ``a`` folds it into the next.
    """
    a, b = _c(a), _c(b)
    letters_a = F.filter(F.split(a, ""), lambda x: x != "")
    letters_b = F.filter(F.split(b, ""), lambda x: x != "")
    first = F.transform(F.sequence(F.lit(0), F.size(letters_b)), lambda j: (-j).cast("double"))

    def next_row(row: Column, letter: Column) -> Column:
        start = F.array(row[0] - 1.0)

        def cell(acc: Column, j: Column) -> Column:
            diagonal = F.element_at(row, j) + F.when(F.element_at(letters_b, j) == letter, F.lit(1.0)).otherwise(F.lit(0.0))
            above = F.element_at(row, j + 1) - 1.0
            left = F.element_at(acc, -1) - 1.0
            return F.array_append(acc, F.greatest(diagonal, above, left))

        columns = F.when(F.size(letters_b) > 0, F.sequence(F.lit(1), F.size(letters_b))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, start, cell)

    return F.element_at(F.aggregate(letters_a, first, next_row), -1)
