"""Readers and writers for hit files, accession maps, trees and reports."""
