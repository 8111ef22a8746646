"""Predicate trees and their compilation to Catalyst expressions."""
