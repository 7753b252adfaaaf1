"""The query language: tokens, syntax trees and the parser."""
